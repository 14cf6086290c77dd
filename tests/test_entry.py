"""The entry module, and that it stands without the llm folder and the pipeline."""

import subprocess
import sys
from pathlib import Path

ROOT = Path(__file__).resolve().parent.parent
SF = "/root/testdata/sf0.001"


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0


def test_every_oracle_has_a_query():
    import __spark_entry__ as entry

    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_rest_stands_alone(tmp_path):
    code = (
        "import sys, importlib.abc\n"
        "class No(importlib.abc.MetaPathFinder):\n"
        "    def find_spec(self, name, path=None, target=None):\n"
        "        if name.startswith('weftline.llm') or name == 'corpus_pipeline':\n"
        "            raise ModuleNotFoundError(name, name=name)\n"
        "sys.meta_path.insert(0, No())\n"
        "import __spark_entry__ as e\n"
        "q = e.queries()\n"
        "assert q and not any(n.startswith('op1') or n == 'pipeline' for n in q)\n"
        "assert e.oracle_sql()\n"
    )
    subprocess.run([sys.executable, "-c", code], cwd=ROOT, check=True)


def test_queries_against_oracle(spark):
    """A sample of queries, one for each family, against DuckDB at the smallest scale."""
    import duckdb

    import __spark_entry__ as entry

    names = ["stylometry_counts", "conv_turn_pairs", "pii_extract_card", "reference_rank", "roc_curve", "vec_cross_entropy", "token_burstiness", "rank_pattern", "group_aggregate", "validate_scores"]
    con = duckdb.connect()
    for f in Path(SF).glob("*.parquet"):
        con.sql(f"create view {f.stem} as select * from '{f}'")
    for name in names:
        got = entry.queries()[name](spark, SF)
        columns = sorted(got.columns)
        want = con.sql(entry.oracle_sql()[name])
        assert sorted(want.columns) == columns, name
        plain = lambda rows: sorted(str([round(x, 6) + 0.0 if isinstance(x, float) else x for x in r]) for r in rows)
        assert plain(tuple(r) for r in got.select(columns).collect()) == plain(con.sql(f"select {', '.join(columns)} from ({entry.oracle_sql()[name]})").fetchall()), name
