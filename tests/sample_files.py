"""A small project of many kinds of files."""

from pyspark.sql import DataFrame, SparkSession

from loomgraph.plans.project import Project, analyze

FILES = {
    "package.json": '{"name": "shop", "main": "dist/server.js", "type": "module", "scripts": {"start": "node src/cli.mjs", "pack": "esbuild src/server.ts --outfile=web/out.js"}, "dependencies": {"moment": "1"}}',
    "tsconfig.json": '{"compilerOptions": {"outDir": "./dist", "rootDir": "src", "paths": {"~/*": ["src/*"]}}, // sources\n}',
    "index.html": '<script type="module" src="/src/web/app.js"></script>\n<script src="web/legacy.js"></script>',
    "src/server.ts": 'import { total } from "~/cart";\nimport { log } from "./log.js";\nconst port = process.env.PORT;\nexport function serve(app) {\n  app.get("/", total);\n  log(total([1]));\n  db.query("x");\n  lost();\n}\n',
    "src/cart.ts": 'import type { Item } from "./types";\nimport { log } from "./log";\nexport function total(items) {\n  let sum = 0;\n  for (const i of items) {\n    sum += i;\n  }\n  log(sum);\n  return sum;\n}\n',
    "src/basket.ts": 'import { log } from "./log";\nexport function amount(things) {\n  let n = 0;\n  for (const t of things) {\n    n += t;\n  }\n  log(n);\n  return n;\n}\n',
    "src/types.ts": "export interface Item { id: string }\n",
    "src/log.ts": 'import { serve } from "./server";\nexport const log = (x) => console.log(x);\n',
    "src/cli.mjs": '#!/usr/bin/env node\nimport { amount } from "./basket";\nconst { HOME, DEBUG } = process.env;\namount([]);\n',
    "src/web/app.js": 'var old = 1;\nimport("./page.js");\n',
    "src/web/page.js": "export default 1;\n",
    "web/out.js": "bundle()", "web/legacy.js": "var x;", "src/forgotten.js": "export const gone = 1;\n",
    "pages/api/buy.ts": "export default function buy(req) { return 1 }\n",
    "tests/cart.test.ts": 'import { total } from "../src/cart";\ntest(total([]));\n',
    "jobs/run.py": "import jobs.task\nif __name__ == '__main__':\n    pass\n", "jobs/task.py": "def work():\n    pass\n",
    "app/Main.java": "import shop.Cart;\npublic class Main {\n  public static void main(String[] a) {}\n}\n", "lib/shop/Cart.java": "public class Cart {\n  public int size() { return 0; }\n}\n",
    "tool.rb": "require_relative 'lib/help'\ndef go\nend\n", "lib/help.rb": "module Help\nend\n", "index.php": "<?php\nrequire __DIR__ . '/inc/db.php';\nfunction show() {}\n", "inc/db.php": "<?php\nclass Db {}\n",
}


def sample_rows(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(k, v, len(v)) for k, v in FILES.items()], "file string, text string, size long")


def sample(spark: SparkSession) -> Project:
    return analyze(sample_rows(spark), [("src/forgotten.js", "intentional-dormant")])
