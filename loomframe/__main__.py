"""Jobs: ``python -m loomframe list`` names the queries, ``run NAME --data DIR [--out DIR]`` runs one, ``sql NAME`` shows its SQL."""

from __future__ import annotations

import argparse

from loomframe.plans import catalogue


def main(argv: list[str] | None = None) -> None:
    parser = argparse.ArgumentParser(prog="loomframe", description=__doc__)
    verbs = parser.add_subparsers(dest="verb", required=True)
    verbs.add_parser("list")
    verbs.add_parser("sql").add_argument("name", choices=sorted(catalogue.SQL))
    run = verbs.add_parser("run")
    run.add_argument("name", choices=sorted(catalogue.QUERIES))
    run.add_argument("--data", required=True, help="folder of the tables' Parquet files")
    run.add_argument("--out", help="folder for the result as Parquet; without it the first rows are shown")
    given = parser.parse_args(argv)
    if given.verb == "list":
        print("\n".join(sorted(catalogue.QUERIES)))
    elif given.verb == "sql":
        print(catalogue.SQL[given.name])
    else:
        from pyspark.sql import SparkSession

        spark = SparkSession.builder.appName(f"loomframe {given.name}").config("spark.sql.session.timeZone", "UTC").getOrCreate()
        result = catalogue.QUERIES[given.name](spark, given.data)
        if given.out:
            result.write.parquet(given.out)
        else:
            result.show(20, False)


if __name__ == "__main__":
    main()
