"""Run registered queries against their SQL twins: `python -m checks.compare SF_DIR [query ...]`."""

import sys
import time

import duckdb
import pandas as pd
from pyspark.sql import SparkSession

from .catalog import QUERIES
from .oracle import ORACLE

TABLES = (
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents",
    "embeddings", "pages", "benchmark", "labels", "conversations",
)


def local_session(cores=8):
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .config("spark.sql.shuffle.partitions", str(cores))
        .config("spark.driver.memory", "12g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        # Small test tables, much work per byte: do not merge small partitions into one task.
        .config("spark.sql.adaptive.coalescePartitions.minPartitionSize", "32k")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def database(sf_dir):
    db = duckdb.connect()
    for name in TABLES:
        db.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{sf_dir}/{name}.parquet')")
    return db


DUCKDB_TYPES = {
    "bigint": "BIGINT",
    "int": "INTEGER",
    "double": "DOUBLE",
    "string": "VARCHAR",
    "date": "DATE",
    "timestamp_ntz": "TIMESTAMP",
}


def type_differences(df, db, sql) -> str:
    mine = {name: DUCKDB_TYPES.get(kind, kind) for name, kind in df.dtypes}
    theirs = {name: kind for name, kind, *_ in db.execute(f"DESCRIBE {sql}").fetchall()}
    return ", ".join(f"{c}: {mine.get(c)} / {theirs.get(c)}" for c in sorted({*mine, *theirs}) if mine.get(c) != theirs.get(c))


def canonical(frame: pd.DataFrame) -> pd.DataFrame:
    frame = frame[sorted(frame.columns)].copy()
    for c in frame.columns:
        if pd.api.types.is_datetime64_any_dtype(frame[c]):
            frame[c] = frame[c].astype("datetime64[us]").astype(str)
        elif frame[c].dtype.kind in "iufb":
            frame[c] = frame[c].astype("float64").map(lambda x: "NULL" if x != x else repr(round(x, 6) + 0.0))
        else:
            frame[c] = frame[c].map(lambda x: "NULL" if x is None or x != x else str(x))
    return frame.sort_values(list(frame.columns)).reset_index(drop=True)


def differences(mine: pd.DataFrame, theirs: pd.DataFrame) -> str:
    """Empty when both hold the same rows."""
    if sorted(mine.columns) != sorted(theirs.columns):
        return f"columns {sorted(mine.columns)} / {sorted(theirs.columns)}"
    if len(mine) != len(theirs):
        return f"{len(mine)} / {len(theirs)} rows"
    a, b = canonical(mine), canonical(theirs)
    for c in a.columns:
        off = a[c] != b[c]
        if off.any():
            at = off.idxmax()
            return f"{int(off.sum())} differ in {c}: {a[c][at][:120]!r} / {b[c][at][:120]!r}"
    return ""


def main(sf_dir, names):
    spark, db = local_session(), database(sf_dir)
    failed = 0
    for name in names or QUERIES:
        start = time.time()
        try:
            df = QUERIES[name](spark, sf_dir)
            mine = df.toPandas()
            spent = time.time() - start
            if name not in ORACLE:
                problem, sql = "", 0.0
            else:
                start = time.time()
                theirs = db.execute(ORACLE[name]).df()
                sql = time.time() - start
                problem = differences(mine, theirs) or type_differences(df, db, ORACLE[name])
            kind = "rows only" if name not in ORACLE else "equal"
            print(f"{name}: {problem or kind} ({len(mine)} rows, {spent:.1f} s, sql {sql:.1f} s)", flush=True)
        except Exception as error:  # report and go on with the next query
            problem = str(error)
            print(f"{name}: FAILED {type(error).__name__} {problem[:600]}", flush=True)
        failed += bool(problem)
    print(f"{failed} failed")
    return failed


if __name__ == "__main__":
    sys.exit(1 if main(sys.argv[1], sys.argv[2:]) else 0)
