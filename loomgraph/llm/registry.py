"""Queries of this subpackage, each over the whole of its table."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from ..session import table
from .bpe import token_digests
from .class_lm import class_scores
from .collocations import collocations
from .contamination import contamination_digests
from .crosspoly import near_vectors
from .jaccard import jaccard_join
from .langid import held_out, language_of
from .mincut import extract_pages
from .mixing import mix_plan
from .sharding import shard_by_bytes
from .simhash import edited_fingerprints, with_near
from .spelling import spelling_variants
from .suffixes import repeat_digests


def op1_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_plan(table(spark, sf_dir, "documents"))


def op2_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    return token_digests(table(spark, sf_dir, "documents"), path, public_tokenizers.PATTERN)


def op3_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard_by_bytes(table(spark, sf_dir, "documents"), shards=8)


def op4_class_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return class_scores(table(spark, sf_dir, "documents"), train=~held_out(folds=7))


def op5_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_of(table(spark, sf_dir, "documents"))


def op6_suffixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeat_digests(table(spark, sf_dir, "documents"), length=200)


def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text against itself with its last half replaced by the beginning
    of the next document's, and against that next document; n_near counts the
    other fingerprints within three bits of its own."""
    return with_near(edited_fingerprints(table(spark, sf_dir, "documents")))


def op8_mincut(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_pages(table(spark, sf_dir, "pages"))


def op9_crosspoly(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_vectors(table(spark, sf_dir, "embeddings"), least=0.93)


def op10_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Class and number of links of every document: five words, 0.8."""
    found = jaccard_join(table(spark, sf_dir, "documents"), threshold=0.8, words=5)
    return found.select("doc_id", "class_id", "n_links")


def op11_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every word of five letters and three occurrences with its best near word."""
    return spelling_variants(table(spark, sf_dir, "documents"))


def op12_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of every document in windows of ten words of the benchmark."""
    return contamination_digests(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), window=10)


def op13_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 2000 best collocations of every language, of 30 occurrences or more."""
    return collocations(table(spark, sf_dir, "documents"), least=30, top=2000)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_mixing": op1_mixing,
    "op2_bpe": op2_bpe,
    "op3_sharding": op3_sharding,
    "op4_class_lm": op4_class_lm,
    "op5_langid": op5_langid,
    "op6_suffixes": op6_suffixes,
    "op7_simhash": op7_simhash,
    "op8_mincut": op8_mincut,
    "op9_crosspoly": op9_crosspoly,
    "op10_jaccard": op10_jaccard,
    "op11_spelling": op11_spelling,
    "op12_decontamination": op12_decontamination,
    "op13_collocations": op13_collocations,
}
_LOWER = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_LEAK_WORDS = f"regexp_extract_all({_LOWER}, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"
ORACLES: dict[str, str] = {
    "op6_suffixes": """
        WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
        parts AS (SELECT doc_id, p, substr(h, 2 * p + 1, 910) AS part FROM (SELECT doc_id, h, unnest(range(0, CAST(length(h) // 2 - 199 AS BIGINT), 256)) AS p FROM d)),
        places AS (SELECT doc_id, p + j AS i, hash(substr(part, 2 * j + 1, 400)) AS w FROM (SELECT doc_id, p, part, unnest(range(0, CAST(least(256, length(part) // 2 - 199) AS BIGINT))) AS j FROM parts)),
        twice AS (SELECT doc_id, i FROM places WHERE w IN (SELECT w FROM places GROUP BY w HAVING count(*) > 1)),
        marked AS (SELECT doc_id, i, CAST(coalesce(i - lag(i) OVER (PARTITION BY doc_id ORDER BY i) > 200, true) AS INT) AS new FROM twice),
        runs AS (SELECT doc_id, i, sum(new) OVER (PARTITION BY doc_id ORDER BY i) AS r FROM marked),
        spans AS (SELECT doc_id, min(i) AS a, max(i) + 200 AS z FROM runs GROUP BY doc_id, r),
        gaps AS (SELECT doc_id, a, z, coalesce(lag(z) OVER (PARTITION BY doc_id ORDER BY a), 0) AS before FROM spans),
        cut AS (SELECT doc_id, sum(z - a) AS n_removed, count(*) AS n_spans, max(z) AS last, string_agg(substr(h, 2 * before + 1, 2 * (a - before)), '' ORDER BY a) AS head FROM gaps JOIN d USING (doc_id) GROUP BY doc_id)
        SELECT doc_id, CAST(length(h) // 2 AS BIGINT) AS n_bytes, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, coalesce(n_spans, 0) AS n_spans,
               sha256(unhex(coalesce(head, '') || substr(h, 2 * coalesce(last, 0) + 1))) AS kept_sha256 FROM d LEFT JOIN cut USING (doc_id)
    """,
    "op9_crosspoly": """
        WITH RECURSIVE v AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
        usable AS (SELECT *, sqrt(list_dot_product(e, e)) AS size FROM v WHERE label IS NOT NULL AND e IS NOT NULL AND len(e) > 0 AND len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
        links AS (SELECT a.vec_id AS a, b.vec_id AS b FROM usable a JOIN usable b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.e) = len(b.e)
                  WHERE a.size > 0 AND b.size > 0 AND list_dot_product(a.e, b.e) / (a.size * b.size) >= 0.93),
        walk AS (SELECT a, b FROM links UNION SELECT walk.a, links.b FROM walk JOIN links ON walk.b = links.a),
        least AS (SELECT a, min(b) AS low FROM walk GROUP BY a), n AS (SELECT a, count(*) AS n FROM links GROUP BY a)
        SELECT vec_id, coalesce(n, 0) AS n_links, least(vec_id, coalesce(low, vec_id)) AS component_id, vec_id = least(vec_id, coalesce(low, vec_id)) AS kept
        FROM v LEFT JOIN least ON least.a = vec_id LEFT JOIN n ON n.a = vec_id
    """,
    "op10_jaccard": f"""
        WITH RECURSIVE d AS (SELECT doc_id, coalesce(regexp_extract_all({_LOWER}, '[^\\x20\\x09-\\x0D]+'), []) AS w FROM documents),
        s AS (SELECT DISTINCT doc_id, array_to_string(w[i:i + 4], ' ') AS run FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 5, 0) + 2)) AS i FROM d WHERE len(w) > 0)),
        n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
        common AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c FROM s x JOIN s y ON x.run = y.run AND x.doc_id <> y.doc_id GROUP BY ALL),
        links AS (SELECT a, b FROM common JOIN n p ON p.doc_id = a JOIN n q ON q.doc_id = b WHERE 10 * c >= 8 * (p.n + q.n - c)),
        walk AS (SELECT a, b FROM links UNION SELECT walk.a, links.b FROM walk JOIN links ON walk.b = links.a),
        low AS (SELECT a, min(b) AS low FROM walk GROUP BY a), many AS (SELECT a, count(*) AS n_links FROM links GROUP BY a)
        SELECT doc_id, least(doc_id, coalesce(low, doc_id)) AS class_id, coalesce(n_links, 0) AS n_links FROM d LEFT JOIN low ON low.a = doc_id LEFT JOIN many ON many.a = doc_id
    """,
    "op11_spelling": """
        WITH RECURSIVE tab AS (SELECT CAST(i AS BIGINT) AS i, CAST(i AS BIGINT) AS c, 0 AS k FROM range(256) AS r(i)
                     UNION ALL SELECT i, CASE WHEN (c & 1) = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, k + 1 FROM tab WHERE k < 8),
        crc AS (SELECT list(c ORDER BY i) AS t FROM tab WHERE k = 8),
        runs AS (SELECT coalesce(CAST(doc_id AS VARCHAR), '') AS d, unnest(regexp_extract_all(text, '[A-Za-z\u00C0-\u00FF]{5,}')) AS w FROM documents),
        one AS (SELECT d, translate(w, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS w, count(*) AS n FROM runs GROUP BY 1, 2),
        bytes AS (SELECT *, flatten(list_transform(string_split(d || ':' || w, ''), lambda x: CASE WHEN unicode(x) < 128 THEN [CAST(unicode(x) AS BIGINT)]
                  ELSE [CAST(192 + (unicode(x) >> 6) AS BIGINT), CAST(128 + (unicode(x) & 63) AS BIGINT)] END)) AS b FROM one),
        hashed AS (SELECT w, n, xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), b), lambda c, x: xor(c >> 8, t[(xor(c, x) & 255) + 1])), 4294967295) AS h FROM bytes, crc),
        spelt AS (SELECT CASE WHEN h % 97 = 0 THEN substr(w, 1, CAST(h % length(w) AS INT)) || substr(w, CAST(h % length(w) AS INT) + 2) ELSE w END AS w, n FROM hashed),
        v AS (SELECT w, CAST(sum(n) AS BIGINT) AS n FROM spelt WHERE length(w) >= 5 GROUP BY 1 HAVING sum(n) >= 3),
        places AS (SELECT w, n, unnest(range(1, length(w) + 1)) AS i FROM v),
        masks AS (SELECT DISTINCT w, n, substr(w, 1, i - 1) || '*' || substr(w, i + 1) AS m FROM places),
        dels AS (SELECT DISTINCT w, n, substr(w, 1, i - 1) || substr(w, i + 1) AS m FROM places),
        pairs AS (SELECT a.w, b.w AS o, b.n FROM masks a JOIN masks b ON a.m = b.m AND a.w <> b.w
                  UNION SELECT a.w, v.w, v.n FROM dels a JOIN v ON v.w = a.m UNION SELECT v.w, a.w, a.n FROM dels a JOIN v ON v.w = a.m),
        near AS (SELECT w, count(*) AS n_near, first(o ORDER BY n DESC, o) AS best, max(n) AS best_n FROM pairs GROUP BY 1),
        f AS (SELECT v.w, v.n, coalesce(n_near, 0) AS n_near, CASE WHEN best_n >= 2 * v.n THEN best END AS form, CASE WHEN best_n >= 2 * v.n THEN best_n END AS form_n FROM v LEFT JOIN near USING (w)),
        walk AS (SELECT w, w AS tail, 0 AS k FROM f UNION ALL SELECT walk.w, f.form, k + 1 FROM walk JOIN f ON f.w = walk.tail WHERE f.form IS NOT NULL),
        roots AS (SELECT w, arg_max(tail, k) AS root FROM walk GROUP BY 1)
        SELECT w AS word, form, root, n, n_near, form_n FROM f JOIN roots USING (w)
    """,
    "op12_decontamination": f"""
        WITH d AS (SELECT doc_id, coalesce({_LEAK_WORDS}, []) AS w FROM documents),
        b AS (SELECT CAST(item_id AS VARCHAR) AS item_id, {_LEAK_WORDS} AS w FROM benchmark),
        bw AS (SELECT item_id, j, least(len(w), 10) AS m, array_to_string(w[j:j + least(len(w), 10) - 1], ' ') AS win
               FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 10, 0) + 2)) AS j FROM b WHERE len(w) > 0)),
        dw AS (SELECT doc_id, m, i, array_to_string(w[i:i + m - 1], ' ') AS win
               FROM (SELECT doc_id, w, m, unnest(range(1, len(w) - m + 2)) AS i FROM d, (SELECT DISTINCT m FROM bw) WHERE len(w) >= m)),
        hit AS (SELECT doc_id, i, j, m, item_id FROM dw JOIN bw USING (m, win)),
        hits AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + m)) AS p FROM (SELECT DISTINCT doc_id, i, m FROM hit)) GROUP BY doc_id),
        items AS (SELECT doc_id, count(*) AS n_items, sha256(string_agg(item_id, ',' ORDER BY item_id)) AS items_sha256 FROM (SELECT DISTINCT doc_id, item_id FROM hit) GROUP BY doc_id),
        islands AS (SELECT doc_id, m, i - row_number() OVER (PARTITION BY doc_id, item_id, m, i - j ORDER BY i) AS island, item_id, i - j AS diagonal FROM hit),
        far AS (SELECT doc_id, max(n) AS longest FROM (SELECT doc_id, count(*) + m - 1 AS n FROM islands GROUP BY doc_id, m, item_id, diagonal, island) GROUP BY doc_id)
        SELECT doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, coalesce(items_sha256, sha256('')) AS items_sha256,
               coalesce(n_hit, 0) > 0 AS contaminated, coalesce(longest, 0) AS longest
        FROM d LEFT JOIN hits USING (doc_id) LEFT JOIN items USING (doc_id) LEFT JOIN far USING (doc_id)
    """,
    "op13_collocations": f"""
        WITH pieces AS (SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex({_LOWER}, '[.,;:!?\\x0A-\\x0D]')) AS piece FROM documents),
        lists AS (SELECT lang, regexp_extract_all(piece, '[^\\x20\\x09]+') AS w FROM pieces),
        total AS (SELECT lang, CAST(sum(len(w)) AS BIGINT) AS n FROM lists GROUP BY lang),
        grams AS (SELECT lang, size, array_to_string(w[i:i + size - 1], ' ') AS phrase
                  FROM (SELECT lang, w, size, unnest(range(1, len(w) - size + 2)) AS i FROM lists, range(1, 5) AS sizes(size) WHERE len(w) >= size)),
        f AS (SELECT lang, size, phrase, count(*) AS n FROM grams GROUP BY ALL HAVING count(*) >= 30),
        c AS (SELECT lang, size, phrase, n AS a, string_split(phrase, ' ') AS w FROM f WHERE size > 1),
        cuts AS (SELECT lang, phrase, a, w, k, array_to_string(w[1:k], ' ') AS lp, array_to_string(w[k + 1:], ' ') AS rp FROM (SELECT *, unnest(range(1, size)) AS k FROM c)),
        scored AS (SELECT cuts.lang, cuts.phrase, a, k, x.n AS l, y.n AS r, CAST((2000000::HUGEINT * a) // (x.n::HUGEINT + y.n) AS BIGINT) AS score
                   FROM cuts JOIN f x ON x.lang = cuts.lang AND x.phrase = lp JOIN f y ON y.lang = cuts.lang AND y.phrase = rp),
        one AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
        inside AS (SELECT lang, array_to_string(w[b:b + m - 1], ' ') AS phrase, max(a) AS over
                   FROM (SELECT *, unnest(range(1, size - m + 2)) AS b FROM (SELECT *, unnest(range(2, size)) AS m FROM c WHERE size > 2)) GROUP BY ALL),
        kept AS (SELECT one.* FROM one LEFT JOIN inside USING (lang, phrase) WHERE over IS NULL OR 100::HUGEINT * over < 80::HUGEINT * a)
        SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, score
        FROM kept JOIN total USING (lang) QUALIFY rank <= 2000
    """,
}
