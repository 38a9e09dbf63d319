"""Command line: build and show libraries, audit papers.

python -m inkstone.cli library status FOLDER | library build FOLDER PAGES | audit run FOLDER PAGES OUT [--profile P]
PAGES is a Parquet table (doc, page, text).
"""

from __future__ import annotations

import argparse
import json
from collections.abc import Sequence

from inkstone.api import PROFILES, Engine
from inkstone.operators import citecheck, libraries
from inkstone.session import local_session


def main(argv: Sequence[str] | None = None) -> int:
    p = argparse.ArgumentParser(prog="inkstone")
    kinds = p.add_subparsers(dest="what", required=True)
    library = kinds.add_parser("library").add_subparsers(dest="how", required=True)
    library.add_parser("status").add_argument("folder")
    build = library.add_parser("build")
    run = kinds.add_parser("audit").add_subparsers(dest="how", required=True).add_parser("run")
    for q in (build, run):
        q.add_argument("folder")
        q.add_argument("pages")
    build.add_argument("--force", action="store_true")
    run.add_argument("out")
    run.add_argument("--profile", choices=sorted(PROFILES), default="standard")
    a = p.parse_args(argv)
    spark = local_session("*", "inkstone-cli")
    if a.how == "status":
        print(json.dumps(libraries.status(spark, a.folder)))
        return 0
    engine = Engine(spark, a.folder, getattr(a, "profile", "standard"), citecheck.hashed_embedding())
    pages = spark.read.parquet(a.pages)
    if a.how == "build":
        print(json.dumps(engine.fit_pages(pages, a.force)))
        return 0
    result = engine.run(pages)
    for doc in [r[0] for r in pages.select("doc").distinct().orderBy("doc").collect()]:  # the papers of one run
        engine.export(result, doc, f"{a.out}/{libraries.slug(doc)}")
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
