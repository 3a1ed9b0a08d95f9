"""HTML extraction, embeddings and the pipeline."""

import itertools
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from loomgraph.llm import crosspoly, mincut


def cut_cost(unary, edges, label):
    return sum(max(0, u) if not x else max(0, -u) for u, x in zip(unary, label, strict=True)) + sum(w for i, j, w in edges if label[i] != label[j])


def test_min_cut_is_minimal():
    rng = random.Random(2)
    for _ in range(60):
        n = rng.randrange(1, 9)
        unary = [rng.uniform(-3, 3) for _ in range(n)]
        edges = [(i, j, rng.uniform(0.1, 2)) for i, j in itertools.combinations(range(n), 2) if rng.random() < 0.5]
        best = min(cut_cost(unary, edges, x) for x in itertools.product([False, True], repeat=n))
        assert math.isclose(cut_cost(unary, edges, mincut.min_cut(unary, edges)), best, abs_tol=1e-9)


PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style></head><body><header><a href=/>Site</a></header>
<nav><ul><li><a href=a>One</a><li><a href=b>Two</a></ul></nav><!-- ad <p>x</p> --><div class="cookie-notice">We use cookies, do you agree to that?</div>
<article><h1>A  title</h1><p>First &amp; best<br>paragraph, <b>bold<i>er</b>.<p>Second has <a href=x>a link</a> in it &mdash; fine.<script>var t="</p>";</script><ul><li>An item of the list.</ul>
<div class="ad">Buy this now, it is the best of all things.</div><form><label>Mail</label><button>Go</button></form></article>
<aside class="sidebar"><p>Something quite unrelated stands here, for a while.</p></aside><section id="comments"><p>I liked this text a lot, thank you.</p></section><footer>&copy; 2024</footer></body></html>"""


def test_page_text():
    assert mincut.main_text(PAGE) == "A title\nFirst & best paragraph, bolder.\nSecond has a link in it — fine.\nAn item of the list."


@pytest.mark.parametrize("page", [None, "", "   ", "<", "<p", "<!--", "<script>", "<a href='x>", "</p></div>", "<nav><a>x</a></nav>", "plain"])
def test_broken_pages_are_defined(page):
    assert isinstance(mincut.main_text(page), str)
    assert page is None or "<" not in page or mincut.main_text(page) == ""


def bare_page(rng):
    """A page without article elements and without names, and its article."""
    say = lambda n: " ".join("".join(rng.choices("abcdefghij", k=rng.randrange(2, 9))) for _ in range(n))
    text = [say(rng.randrange(30, 70)) + "." for _ in range(5)]
    text.insert(2, "So it went on")
    menu = "".join(f"<li><a href=x>{say(2)}</a></li>" for _ in range(rng.randrange(4, 9)))
    #: one wordy entry amid the menu
    menu += "<li>" + say(5) + ".</li>" + "".join(f"<li><a href=x>{say(2)}</a></li>" for _ in range(3))
    return f"<html><body><div><ul>{menu}</ul></div><div>{''.join(f'<p>{t}</p>' for t in text)}</div><div><a href=y>{say(2)}</a></div></body></html>", "\n".join(text)


def test_edges_decide_on_pages_without_names(monkeypatch):
    rng = random.Random(8)
    cases = [bare_page(rng) for _ in range(30)]
    assert [mincut.main_text(page) for page, _ in cases] == [text for _, text in cases]
    monkeypatch.setattr(mincut, "E_NEXT", 0.0)
    monkeypatch.setattr(mincut, "E_PARENT", 0.0)
    alone = [mincut.main_text(page) for page, _ in cases]
    assert all("So it went on" not in got for got in alone) and all(got != text for got, (_, text) in zip(alone, cases, strict=True))


def test_elements_speak_through_edges(monkeypatch):
    assert "A title" in mincut.main_text(PAGE) and "Buy this" not in mincut.main_text(PAGE)
    monkeypatch.setattr(mincut, "E_OWN", 0.0)
    assert "A title" not in mincut.main_text(PAGE)


def test_nested_elements():
    inner = lambda c: f'<article><p>The article says this and that at length.</p><section class="{c}"><div class="content"><p>I liked that text a lot, thank you for it all.</p></div></section></article>'
    assert "liked" not in mincut.main_text(inner("comments")) and "liked" in mincut.main_text(inner("part two"))
    assert mincut.main_text('<div class="sidebar-layout"><article><p>The article says this and that.</p></article></div>') == "The article says this and that."


def test_classifier_is_fitted_on_what_elements_label(spark):
    rng = random.Random(3)
    sums = sum(mincut.labelled(*mincut.blocks(PAGE)) for _ in range(20))
    bias, *weights = mincut.fitted(sums)
    assert weights[1] < 0 and mincut.fitted(sums * 0) == mincut.FALLBACK
    pages = [(k, f"u{k}", PAGE) for k in range(60)] + [(100 + k, "v", bare_page(rng)[0]) for k in range(20)] + [(200, None, None)]
    df = spark.createDataFrame(pages, "page_id long, url string, html string")
    found = mincut.learn_weights(df)
    assert found == mincut.learn_weights(df.repartition(5)) != mincut.FALLBACK and mincut.learn_weights(df.where("false")) == mincut.FALLBACK


def test_long_pages_are_cut_quickly():
    import time

    page = "<body>" + "".join(f"<div><p>{'word ' * (4 + 40 * (k % 2))}</p><p>and so</p></div>" for k in range(15_000)) + "</body>"
    began = time.thread_time()
    assert isinstance(mincut.main_text(page), str)
    assert time.thread_time() - began < 30


def test_pages_table(spark):
    df = spark.createDataFrame([(1, "u", PAGE, "x"), (2, None, None, "x"), (1, "u", PAGE, "x")], "page_id long, url string, html string, text string")
    got = mincut.extract_pages(df).collect()
    assert sorted((r.page_id, r.n_chars) for r in got) == [(1, len(mincut.main_text(PAGE)))] * 2 + [(2, 0)]
    assert mincut.extract_pages(df.where("false")).count() == 0


def test_hadamard_keeps_lengths():
    x = np.random.default_rng(1).normal(size=(5, 16))
    assert np.allclose(np.linalg.norm(crosspoly.hadamard(x), axis=1), np.linalg.norm(x, axis=1)) and np.allclose(crosspoly.hadamard(crosspoly.hadamard(x)), x)


def test_recall_at_the_threshold():
    r = np.random.default_rng(3)
    a = r.normal(size=(1500, 64))
    a /= np.linalg.norm(a, axis=1, keepdims=True)
    b = r.normal(size=a.shape)
    b -= (a * b).sum(axis=1, keepdims=True) * a
    b /= np.linalg.norm(b, axis=1, keepdims=True)
    near = 0.93 * a + math.sqrt(1 - 0.93**2) * b
    meet = (crosspoly.probes(a)[:, :, :, None] == crosspoly.probes(near)[:, :, None, :]).any(axis=(1, 2, 3))
    assert meet.mean() >= 0.99


@pytest.mark.parametrize("block", [1024, 7])
def test_vectors(spark, monkeypatch, block):
    monkeypatch.setattr(crosspoly, "BLOCK", block)
    rng = np.random.default_rng(5)
    base = rng.normal(size=(12, 64))
    rows = [(k, [float(v) for v in np.float32(base[k % 12] + rng.normal(size=64) * 0.12)], k % 3 if k % 5 else 0) for k in range(180)]
    rows += [(200 + k, rows[5][1], rows[5][2]) for k in range(4)] + [(204, rows[5][1], 9), (204, rows[5][1], 9)]
    rows += [(300, None, 1), (301, [0.0] * 64, 1), (302, [float("nan")] * 64, 1), (303, [None] + [1.0] * 63, 1), (304, rows[0][1], None), (305, [1e30] * 64, 1), (306, [1.0] * 3, 1), (307, [2.0] * 3, 1), (308, [], 1)]
    df = spark.createDataFrame([(*r, "x") for r in rows], "vec_id long, embedding array<float>, label int, rep string").repartition(3)
    usable = [label is not None and v is not None and len(v) > 0 and all(x is not None and math.isfinite(x) for x in v) and any(v) for _, v, label in rows]
    links, root = [0] * len(rows), list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, j in itertools.combinations(range(len(rows)), 2):
        (_, a, la), (_, b, lb) = rows[i], rows[j]
        if usable[i] and usable[j] and la == lb and len(a) == len(b):
            a, b = np.array(a), np.array(b)
            if a / np.linalg.norm(a) @ (b / np.linalg.norm(b)) >= 0.93:
                links[i] += 1
                links[j] += 1
                root[find(i)] = find(j)
    low = {}
    for i, r in enumerate(rows):
        low[find(i)] = min(low.get(find(i), r[0]), r[0])
    want = sorted((r[0], links[i], low[find(i)], r[0] == low[find(i)]) for i, r in enumerate(rows))
    assert sorted(tuple(r) for r in crosspoly.near_vectors(df).collect()) == want
    if block == 1024:
        assert crosspoly.near_vectors(df.where("false")).count() == 0


def test_pipeline_against_brute_force(spark, odd_docs, tmp_path):
    import hashlib
    from collections import Counter

    import public_tokenizers
    import tiktoken

    import corpus_pipeline
    from loomgraph.llm.bpe import tokenizer

    from .test_documents import classes_by_brute_force

    docs = odd_docs.select("doc_id", "text", "lang", "source", "n_chars")
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    step, seen = docs, {}
    for name, stage in corpus_pipeline.STAGES:
        step = stage(spark, step, str(tmp_path)).cache()
        seen[name] = step
        assert name == "tokens" or step.columns == docs.columns
    gone = {r.doc_id for r in docs.collect()} - {r.doc_id for r in seen["language"].collect()}
    assert {90, 91, 92, 94} <= gone and 93 not in gone
    first = [(r.doc_id, r.text) for r in seen["language"].collect()]
    kept = Counter(r.doc_id for r in seen["near_duplicates"].collect())
    assert kept == Counter({d for d, c, _ in classes_by_brute_force(first) if d == c})
    #: repeats, by the strings that occur twice
    second = [(r.doc_id, r.text) for r in seen["near_duplicates"].collect()]
    strings = Counter(x for _, t in second for raw in [(t or "").encode()] for x in (raw[i : i + 200] for i in range(len(raw) - 199)))
    want = Counter()
    for d, t in second:
        raw = (t or "").encode()
        gone = {j for i in range(len(raw) - 199) if strings[raw[i : i + 200]] > 1 for j in range(i, i + 200)}
        want[d, bytes(x for j, x in enumerate(raw) if j not in gone).decode("utf-8", "ignore")] += 1
    third = seen["repeats"].collect()
    assert Counter((r.doc_id, r.text or "") for r in third) == want and all(r.n_chars == len(r.text or "") for r in third)
    #: the mix: every source near its target, no document above twice its words
    words = lambda rows: Counter({s: sum(len((r.text or "").encode().split()) for r in rows if r.source == s) for s in {r.source for r in third}})
    sizes, mixed = words(third), seen["mix"].collect()
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(order)}
    goal, free, left = {}, set(order), 1.5 * sum(sizes.values())
    while over := [s for s in free if left * weight[s] / sum(weight[x] for x in free) > 2 * sizes[s]]:
        for s in over:
            goal[s] = 2 * sizes[s]
        free -= set(over)
        left = 1.5 * sum(sizes.values()) - sum(goal.values())
    goal |= {s: left * weight[s] / sum(weight[x] for x in free) for s in free}
    assert all(abs(words(mixed)[s] - goal[s]) <= max(2, 0.02 * goal[s]) or len([r for r in third if r.source == s]) < 3 for s in order)
    assert max(Counter(r.doc_id for r in mixed).values()) <= 2 and {(r.doc_id, r.text) for r in mixed} <= {(r.doc_id, r.text) for r in third}
    coder = tokenizer(public_tokenizers.path(corpus_pipeline.TOKENIZER), public_tokenizers.PATTERN)
    ref = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=coder.ranks, special_tokens={})
    want = Counter()
    for r in mixed:
        ids = ref.encode_ordinary(r.text)
        want[r.doc_id, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()] += 1
    last = Counter((r.doc_id, r.n_tokens, r.ids_sha256) for r in corpus_pipeline.run(spark, str(tmp_path)).collect())
    assert last == want and max(want.values()) <= 2


def test_repeated_and_null_ids_keep_their_rows(spark):
    rows = [(1, "a", [1.0, 0.0]), (1, "a", None), (1, "a", [0.0, 0.0]), (1, None, [1.0, 0.0]), (None, "a", [0.0, 1.0]), (None, "a", [float("nan"), 1.0])]
    got = crosspoly.near_vectors(spark.createDataFrame(rows, "vec_id long, label string, embedding array<double>")).collect()
    assert sorted((r.vec_id or 0, r.n_links) for r in got) == [(0, 0)] * 2 + [(1, 0)] * 4


def test_stages_keep_columns_of_clashing_names(spark, odd_docs, no_docs):
    import corpus_pipeline

    names = ["score", "rejected", "lang_pred", "target", "whole", "size", "taken", "windows", "class_key", "text_hash", "_copy", "_id", "source_size"]
    for docs in (odd_docs, no_docs):
        wide = docs.select("doc_id", "text", "lang", "source", "n_chars", *[F.concat(F.lit(name), F.col("doc_id").cast("string")).alias(name) for name in names])
        for name, stage in corpus_pipeline.STAGES[:-1]:
            got = stage(spark, wide, "")
            assert got.columns == wide.columns, name
            assert all(r[c] == (None if r.doc_id is None else f"{c}{r.doc_id}") for r in got.collect() for c in names), name


def test_shared_ids_of_different_texts_stay(spark):
    import corpus_pipeline

    rng = random.Random(2)
    line = lambda n: " ".join(f"w{rng.randrange(500)}" for _ in range(n))
    a, b, c = line(60), line(60), line(60)
    rows = [(1, a), (1, b), (2, a + " end"), (3, b + " end"), (None, c), (None, c + " end"), (4, a), (5, ""), (5, ""), (6, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted(((r.doc_id or 0), r.text or "") for r in corpus_pipeline.near_duplicates(spark, docs, "").collect())
    assert got[0][1] in (c, c + " end") and got[1:] == sorted([(1, a), (1, b), (5, ""), (5, ""), (6, "")])


def lying_page(rng):
    """A page whose names say little or the wrong thing, and its article."""
    word = lambda: "".join(rng.choice("abcdefghilmnoprstuv") for _ in range(rng.randrange(2, 9)))
    line = lambda n: " ".join(word() for _ in range(n)).capitalize() + "."
    body = []
    for _ in range(rng.randrange(4, 9)):
        body.append(line(rng.randrange(25, 60)))
        if rng.random() < 0.5:
            body.append(line(2))
    inner = "".join(f"<p>{x}</p>" for x in body)
    holder = rng.choice(['<section id="search">{}</section>', '<section id="login"><div>{}</div></section>', '<div class="content alert">{}</div>', '<div class="post share">{}</div>', '<div class="legal">{}</div>', "<div>{}</div>"])
    links = lambda n: "".join(f'<li><a href="/{k}">{word()}</a></li>' for k in range(n))
    around = rng.choice(["<article>{}</article>", "<div class=wrap>{}</div>"])
    page = f"<body><ul>{links(6)}</ul>{around.format(holder.format(inner))}<div class=\"notice\">{line(9)}</div><ul>{links(4)}</ul></body>"
    return page, "\n".join(body)


def overlap(a, b):
    """Share of characters, by lines, that two texts have in common."""
    a, b = a.split("\n"), b.split("\n")
    common = sum(len(x) for x in set(a) & set(b))
    return 2 * common / max(1, sum(map(len, set(a))) + sum(map(len, set(b))))


def test_texts_overrule_names_that_lie():
    rng = random.Random(6)
    pages = [lying_page(rng) for _ in range(80)]
    scores = [overlap(mincut.main_text(page), text) for page, text in pages]
    assert sum(scores) / len(scores) > 0.95


def test_edges_carry_short_lines_of_lying_sections(monkeypatch):
    rng = random.Random(7)
    pages = [lying_page(rng) for _ in range(40)]
    kept = lambda: [line for page, text in pages for line in text.split("\n") if len(line) < 30 and line in mincut.main_text(page).split("\n")]
    with_edges = kept()
    for name in ("E_NEXT", "E_PARENT", "E_VAGUE", "E_OWN", "E_ABOVE"):
        monkeypatch.setattr(mincut, name, 0.0)
    assert len(with_edges) > 40 and len(kept()) < len(with_edges) / 2


def test_words_of_parts_of_an_article():
    long = "<p>" + "The engine walks an index of terms and ranks documents by their scores, quickly. " * 2 + "</p>"
    assert mincut.main_text(f'<article>{long}<section id="search">{long}{long}</section></article>').count("\n") == 2
    assert mincut.main_text(f'<div class="search">Search</div><div class="content">{long}</div><div class="comments">{long}{long}</div>').count("\n") == 0
    assert "cookies" not in mincut.main_text(f'<article>{long}<div class="notice">This site uses cookies for you and for us all.</div>{long}</article>')
