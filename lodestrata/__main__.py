"""python -m lodestrata corpus PATH [--json] | app PATH"""

import json
import sys

from pyspark.sql import SparkSession


def main(args: list[str]) -> int:
    if len(args) < 2 or args[0] not in ("corpus", "app"):
        print(__doc__, file=sys.stderr)
        return 2
    from .operators import appscan
    from .sources import files

    spark = SparkSession.builder.config("spark.ui.showConsoleProgress", "false").getOrCreate()
    try:
        if args[0] == "app":
            for r in appscan.observations(appscan.project(spark, args[1])).orderBy("path", "line").collect():
                print(json.dumps(r.asDict()))
            return 0
        parts = files.analyze(spark, args[1])
        print(json.dumps([r.asDict() for r in parts["findings"].collect()]) if "--json" in args else files.text_report(parts))
        return 0
    except NotADirectoryError as error:
        print(f"not a directory: {error}", file=sys.stderr)
        return 2


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
