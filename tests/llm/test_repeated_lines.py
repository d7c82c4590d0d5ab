"""Problem 4 against counting by hand."""

import re
from collections import Counter

from feedmill.llm.repeated_lines import frequent_sequences, remove_repeated, repeated_lines

ROWS = (
    [(k, 1, f"  Share THIS \tstory {k}\nBy the newsdesk\nfact {chr(97 + k % 26)}{chr(97 + k // 26)} happened") for k in range(60)]
    + [(100 + k, 1, f"unique text {chr(97 + k % 26)}\nrare line" if k < 4 else f"other {chr(97 + k % 26)}x") for k in range(10)]
    + [(200 + k, 2, "Subscribe\nSubscribe\n\n" if k < 5 else None) for k in range(8)]
    + [(300 + k, None, "Subscribe") for k in range(9)]
    + [(400, 2, ""), (401, 3, "x" * 200_000), (402, 1, "SHARE this story 7\r\nlast")]
)
SCHEMA = "id long, source_id long, text string"


def _by_hand():
    counts, totals = Counter(), Counter()
    for _, source, text in ROWS:
        if source is None:
            continue
        totals[source] += 1
        lines = {re.sub("[0-9]+", "0", " ".join(x.lower().split())) for x in (text or "").split("\n")} - {""}
        counts.update((source, x) for x in lines)
    return {k for k, n in counts.items() if n >= 5 and n * 50 >= totals[k[0]]}


def test_lines(spark):
    rows = spark.createDataFrame(ROWS, SCHEMA)
    got = {(r.source_id, r.line) for r in repeated_lines(rows).collect()}
    assert got == _by_hand() and (1, "share this story 0") in got and (2, "subscribe") in got


def test_sequences(spark):
    rows = spark.createDataFrame(ROWS, SCHEMA)
    got = {(r.source, tuple(r.sequence)): r.n for r in frequent_sequences(rows).collect()}
    assert got[1, ("share this story 0", "by the newsdesk")] == 60
    assert got[2, ("subscribe", "subscribe")] == 5 and (2, ("subscribe",)) not in got
    assert (1, ("by the newsdesk", "share this story 0")) not in got


def test_removal(spark):
    rows = spark.createDataFrame(ROWS, SCHEMA)
    got = {r.id: r.text for r in remove_repeated(rows).collect()}
    assert len(got) == len(ROWS)
    assert got[0] == "fact aa happened" and got[402] == "last" and got[207] is None and got[400] == "" and got[300] == "Subscribe" and got[200] == "\n"
    assert remove_repeated(rows.limit(0)).collect() == []
    assert repeated_lines(rows.limit(0)).collect() == []


def test_gaps_and_long_blocks(spark):
    """Other lines may stand between a sequence's; a block of 200 lines that always stands together is one closed sequence."""
    block = [f"line {chr(97 + k // 26)}{chr(97 + k % 26)}" for k in range(200)]
    rows = [(k, 1, f"first\nown {chr(97 + k)}\nsecond" + ("\nthird" if k < 6 else "")) for k in range(12)] + [(100 + k, 2, "\n".join(block)) for k in range(6)]
    rows += [(100, 2, "\n".join(block))]
    got = {(r.source, tuple(r.sequence)): r.n for r in frequent_sequences(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got == {(1, ("first", "second")): 12, (1, ("first", "second", "third")): 6, (1, ("second",)): 12, (1, ("second", "third")): 6, (2, tuple(block)): 7} or got == {(1, ("first", "second")): 12, (1, ("first", "second", "third")): 6, (2, tuple(block)): 7}


def test_mining_decides(spark, monkeypatch):
    """Without the mined sequences no line is found and none is removed."""
    rows = spark.createDataFrame(ROWS, SCHEMA)
    monkeypatch.setattr("feedmill.llm.repeated_lines._closed", lambda sequences: sequences.limit(0))
    assert repeated_lines(rows).collect() == []
    assert {r.id: r.text for r in remove_repeated(rows).collect()} == {r[0]: r[2] for r in ROWS}
