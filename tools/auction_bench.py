"""Times the auction benchmark's queries over a million events and prints a Markdown table row by row."""

import shutil
import statistics
import sys
import tempfile
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

from millrace.plans import nexmark  # noqa: E402
from millrace.session import session  # noqa: E402
from millrace.sources.sinks import drain  # noqa: E402


def main(cores: str) -> None:
    folder = tempfile.mkdtemp(prefix="auctions-")
    spark = session("auctions", f"local[{cores}]", **{"spark.ui.enabled": "false", "spark.sql.shuffle.partitions": cores, "spark.driver.memory": "4g"})
    spark.sparkContext.setLogLevel("ERROR")
    try:
        for name, mix in (("bids", (1, 0, 0)), ("people", (0, 3, 1))):
            for n, df in nexmark.generate(spark, 1_000_000, *mix).items():
                df.write.parquet(f"{folder}/{name}/{n}")
        bid = spark.read.parquet(f"{folder}/bids/bid")
        a, p = (spark.read.parquet(f"{folder}/people/{n}") for n in ("auction", "person"))
        runs = {
            "q1": lambda: drain(nexmark.q1(bid)),
            "q1-io": lambda: nexmark.q1_io(bid),
            "q3": lambda: drain(nexmark.q3(a, p)),
            "q3-opt": lambda: drain(nexmark.q3_opt(a, p)),
            "q3-io": lambda: nexmark.q3_io(a, p),
        }
        for name, run in runs.items():
            took = []
            for _ in range(7):
                began = time.perf_counter()
                run()
                took.append(time.perf_counter() - began)
            print(f"| {name} | local[{cores}] | {1000 * statistics.median(took[2:]):.0f} |", flush=True)
    finally:
        spark.stop()
        shutil.rmtree(folder)


if __name__ == "__main__":
    main(sys.argv[1] if len(sys.argv) > 1 else "8")
