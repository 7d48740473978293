"""Command line: profile, extract and convert folders of tables or of PDF files; validate an e-book.

Exit codes: 0 done, 1 nothing to do or a fault (with a report of it, where one
is asked for), 2 validator missing.
"""

from __future__ import annotations

import argparse
import json
import os
import shutil
import subprocess
import sys

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="quire", description=__doc__)
    sub = p.add_subparsers(dest="command", required=True)
    for name in ("profile", "extract", "convert"):
        c = sub.add_parser(name)
        c.add_argument("folder", help="folder with blocks.parquet and doc_ir.parquet, or with PDF files")
        c.add_argument("--out", required=True)
        c.add_argument("--max-pages", type=int)
        if name == "convert":
            c.add_argument("--report", help="folder for the report of each document, or of what went wrong")
            c.add_argument("--documents", help="folder for each document as JSON: metadata, elements, entries")
            c.add_argument("--debug-dir")
            c.add_argument("--keep-artifacts", action="store_true")
            c.add_argument("--no-dehyphenate", action="store_true")
            c.add_argument("--files", action="store_true", help="write one .epub file per document instead of a table of books")
    sub.add_parser("validate").add_argument("book")
    return p


def validate(book: str) -> tuple[int, str]:
    """Result of the external validator, if it is installed."""
    if not os.path.isfile(book):
        return 1, f"no such file: {book}"
    tool = shutil.which("epubcheck")
    if tool is None:
        return 2, "epubcheck is not installed"
    done = subprocess.run([tool, book], capture_output=True, text=True)
    return done.returncode, done.stdout + done.stderr


def recovery(spark: SparkSession, folder: str, **options):
    """Recovery of a folder of tables, or of PDF files, which are read once into tables."""
    from .plans.recovery import Recovery
    from .sources.files import pdf_tables
    from .sources.shared import written

    if os.path.exists(os.path.join(folder, "blocks.parquet")):
        return Recovery.of(spark, folder, **options)
    made = {name: written(df) for name, df in pdf_tables(spark, folder, options.get("max_pages")).items()}
    return Recovery(made["blocks"], made["doc_ir"], images=made["images"], rects=made["rects"], **options)


def debug_views(r) -> dict[str, DataFrame]:
    """What to look at where a result is odd: a table of each kind, in order of place."""
    from .operators import images, layout

    views = {
        "removed_artifacts": r.artifacts, "ordered_blocks": r.ordered.select("doc_id", "read_seq", "block_id", "page_index", "x0", "y0", "x1", "y1", "raw_text"),
        "kept_margin_blocks": layout.kept_margin_blocks(r.kept), "table_fallbacks": r.elements.where("element_type = 'table' and cell_rows is null").select("doc_id", "elem_seq", "element_id", "page_index", "text"),
        "warnings": r.warnings,
    }
    if r.images is not None:
        measured = {*r.images.columns}.issuperset(images.MEASURED) and "data" in r.images.columns
        views["images"] = images.image_status(r.images.withColumn("has_data", F.col("data").isNotNull())) if measured else r.images.drop("data")
    return views


def fault(code: str, message: str, folder: str | None) -> int:
    """Tell what went wrong, and leave a report of it."""
    print(f"{code}: {message}", file=sys.stderr)
    if folder:
        os.makedirs(folder, exist_ok=True)
        report = {"status": "error", "quality_score": 0, "page_count": 0, "verdict": "error", "warnings": [{"code": code, "severity": "error", "message": message, "page_index": None}]}
        with open(os.path.join(folder, "error.json"), "w", encoding="utf-8") as f:
            json.dump(report, f)
    return 1


def main(argv: list[str] | None = None) -> int:
    args = parser().parse_args(argv)
    if args.command == "validate":
        code, said = validate(args.book)
        print(said)
        return code
    report = getattr(args, "report", None)
    if not os.path.isdir(args.folder) and "://" not in args.folder:
        return fault("input_missing", f"no such folder: {args.folder}", report)
    from .sources.sinks import write_epubs, write_json

    spark = SparkSession.builder.appName("quire").getOrCreate()
    options = {"max_pages": args.max_pages}
    if args.command == "convert":
        options |= {"keep_artifacts": args.keep_artifacts, "dehyphenate": not args.no_dehyphenate}
    try:
        r = recovery(spark, args.folder, **options)
        if args.command == "profile":
            write_json(r.profile, args.out)
            write_json(r.pages, f"{args.out}-pages")
        elif args.command == "extract":
            write_json(r.scanned, args.out)
            write_json(r.pages, f"{args.out}-pages")
            if r.images is not None:
                write_json(r.images.drop("data"), f"{args.out}-images")
        else:
            if args.files:
                write_json(write_epubs(r.epubs, args.out), f"{args.out}-list")
            else:
                r.epubs.write.mode("overwrite").parquet(args.out)
            if args.report:
                write_json(r.report, args.report)
            if args.documents:
                write_json(r.documents, args.documents)
            for name, view in debug_views(r).items() if args.debug_dir else ():
                write_json(view, os.path.join(args.debug_dir, name))
    except Exception as e:
        return fault("conversion_failed", str(e), report)
    return 0


if __name__ == "__main__":
    sys.exit(main())
