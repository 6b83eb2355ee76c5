import hashlib
import random
from collections import defaultdict

import pytest

from tallyframe.llm import line_runs

FOLD = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def plain(texts):
    holders = defaultdict(set)
    key = lambda line: line.strip("\x20\x09\x0a\x0b\x0c\x0d").translate(FOLD)
    for doc, text in texts:
        for line in (text or "").split("\n"):
            if len(key(line)) >= 20:
                holders[key(line)].add(doc)
    out = []
    for doc, text in texts:
        lines = (text or "").split("\n")
        kept = [x for x in lines if not (len(holders.get(key(x), ())) >= 3 and doc != max(holders[key(x)]))]
        out.append((doc, len(lines), len(lines) - len(kept), hashlib.sha256("\n".join(kept).encode()).hexdigest()))
    return sorted(out)


def sample():
    rng = random.Random(5)
    common = ["This line is shared by many documents", "  THIS LINE is shared by many documents\t\r", "é" * 19, "é" * 20, "short", "", "x" * 300, " " + "n" * 19, "a\x0bb" * 10]
    texts = [(i, "\n".join(rng.choices(common + [f"own line number {i} of this text"], k=rng.randint(1, 6)))) for i in range(60)]
    return texts + [(100, None), (101, ""), (102, "\n\n"), (103, "long line of words " * 5000 + "\n" + common[0])]


@pytest.mark.parametrize("batches", [1, 2, 7])
def test_against_plain_rule(spark, batches):
    texts = sample()
    df = spark.createDataFrame(texts, "doc_id bigint, text string").selectExpr("*", "1 AS n", "'q' AS digest", "2 AS top", "3 AS batch")
    rows = line_runs.line_decisions(df, batches=batches, fanout=2).collect()
    assert sorted(tuple(r) for r in rows) == plain(texts)


def test_columns_nulls_and_repeats(spark):
    line = "a line long enough to be looked at"
    rows = [(1, line, "p"), (2, f"{line}\nmore", "q"), (3, line.upper(), "r"), (3, line.upper(), "r"), (None, "only here, in a row without id", None)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, n_dropped string").selectExpr("*", "array(1) AS row_")
    out = line_runs.drop_repeated_lines(df)
    assert out.columns == df.columns
    assert sorted(out.collect(), key=lambda r: r.doc_id or 0) == [
        (None, rows[4][1], None, [1]), (1, "", "p", [1]), (2, "more", "q", [1]),
        (3, line.upper(), "r", [1]), (3, line.upper(), "r", [1]),
    ]
    assert line_runs.drop_repeated_lines(df.limit(0)).collect() == []


def test_runs_are_compacted(spark):
    runs = line_runs.LineRuns(fanout=2)
    for batch in range(5):
        rows = [(bytes([k]), 10 * batch + k) for k in range(batch + 1)]
        runs.add(spark.createDataFrame(rows, "digest binary, doc_id bigint"))
    assert [len(level) for level in runs.levels] == [1, 0, 1]
    found = {bytes(r.digest)[0]: (r.n, r.top) for r in runs.counts().collect()}
    assert found == {k: (5 - k, 40 + k) for k in range(5)}
