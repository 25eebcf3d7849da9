"""Command line: ``python -m citeharbor {run,import,summary,map,stats} --root FOLDER``."""

from __future__ import annotations

import argparse

from pyspark.sql import SparkSession

from citeharbor.plans import jobs
from citeharbor.sources.readers import read_articles_csv


def _parser() -> argparse.ArgumentParser:
    parser = argparse.ArgumentParser(prog="citeharbor")
    steps = parser.add_subparsers(dest="step", required=True)
    run = steps.add_parser("run", help="works and pages to all stored results")
    run.add_argument("--works", help="JSON of nested works; not needed once text is stored")
    run.add_argument("--one-array", action="store_true", help="each file holds one JSON array")
    run.add_argument("--articles", help="CSV of flat articles, in place of works")
    run.add_argument("--pages", help="Parquet of page_id, url, html")
    run.add_argument("--with-text", action="store_true", help="keep the text in the detection table")
    run.add_argument("--reuse", action="store_true", help="use stored articles and text, whatever is given")
    run.add_argument("--collapse-missing-doi", action="store_true", help="keep one work without a DOI")
    run.add_argument("--include-ref-hits", action="store_true", help="works with a citation hit only are detected too")
    run.add_argument("--strict-prefix", action="store_true", help="test the stored DOI for being the archive's own")
    run.add_argument("--docs-first", action="store_true", help="label documents of the archive before evidence")
    taken = steps.add_parser("import", help="take over a detection table kept as CSV")
    taken.add_argument("--detection", required=True, help="CSV of the detection table")
    summary = steps.add_parser("summary", help="dataset summary from the stored detection table")
    summary.add_argument("--merge-numbers", action="store_true",
                         help="group by the numeric dataset number")
    work_map = steps.add_parser("map", help="dataset-to-work map from the stored summary")
    work_map.add_argument("--doi", default="doi", help="summary column that holds the DOI")
    steps.add_parser("stats", help="counts along the run")
    for step in (run, taken, summary, work_map, steps.choices["stats"]):
        step.add_argument("--root", required=True, help="folder of the stored tables")
    for step in (run, summary):
        step.add_argument("--csv", action="store_true", help="write CSV copies as well")
    return parser


def main(arguments: list[str] | None = None) -> None:
    options = _parser().parse_args(arguments)
    spark = SparkSession.builder.appName(f"citeharbor-{options.step}").getOrCreate()
    layout = jobs.Layout(options.root)
    if options.step == "run":
        works = jobs.take_works(spark, layout, options.works, options.one_array) if options.works else None
        pages = spark.read.parquet(options.pages) if options.pages else None
        articles = read_articles_csv(spark, options.articles) if options.articles else None
        jobs.run_detection(spark, layout, works, pages, with_csv=options.csv,
                           with_text=options.with_text, articles=articles, reuse=options.reuse,
                           null_key="collapse" if options.collapse_missing_doi else "keep",
                           include_ref_hits=options.include_ref_hits,
                           strict_prefix=options.strict_prefix, docs_first=options.docs_first)
    elif options.step == "import":
        jobs.import_detection(spark, layout, options.detection)
    elif options.step == "summary":
        if not jobs.summarize(spark, layout, options.csv, options.merge_numbers):
            print("no dataset was found; nothing is written")
    elif options.step == "map":
        jobs.build_map(spark, layout, options.doi)
    else:
        for row in jobs.write_stats(spark, layout).collect():  # ten rows
            print(f"{row['stage']}.{row['metric']}: {row['value']}")


if __name__ == "__main__":
    main()
