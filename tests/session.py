"""One local session for tests and scripts."""

import os

from signalbook.session import build_session


def spark_session():
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = build_session(
        "signalbook-tests",
        f"local[{cpus}]",
        spark__sql__shuffle__partitions="8",
        spark__ui__enabled="false",
        spark__ui__showConsoleProgress="false",
        spark__driver__memory="12g",
    )
    spark.sparkContext.setLogLevel("OFF")
    return spark
