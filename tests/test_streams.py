"""Streams that prune growing sequences, against loops that take one row at a time."""

import pytest

from heddle.plans import QUERIES


@pytest.fixture(scope="module")
def sequences(spark, sf_dir):
    out = {}
    for r in sorted(spark.read.parquet(f"{sf_dir}/events.parquet").select("user_id", "ts", "event_id", "value").collect(), key=lambda r: (r["ts"], r["event_id"])):
        own = out.setdefault(r["user_id"] % 16, [])
        own.append((len(own) + 1, 0.0 if r["value"] is None else r["value"]))
    return out


def best(rows, n):
    return sorted(sorted(rows, key=lambda r: (-r[1], r[0]))[:n])


def every_interval(rows, size):
    held = []
    for seen, row in enumerate(rows, 1):
        held.append(row)
        if seen % 64 == 0 and len(held) > size(seen):
            held = best(held, size(seen))
    return held


def prefilled(rows):
    held = []
    for seen, row in enumerate(rows, 1):
        held.append(row)
        if seen == 128:
            held = best(held, 64)
        elif seen > 128 and seen % 64 == 0 and len(held) > 32:
            held = best(held, 32)
    return held


POLICIES = {
    "stream_decoding_topk": lambda rows: every_interval(rows, lambda seen: 32),
    "stream_ratio_target": lambda rows: every_interval(rows, lambda seen: max(1, int(seen * 0.25))),
    "stream_prefill_decode": prefilled,
}


@pytest.mark.parametrize("name", POLICIES)
def test_stream_is_a_loop(name, spark, sf_dir, sequences):
    got = {(r["seq"], r["step"], r["score"]) for r in QUERIES[name](spark, sf_dir).collect()}
    assert got == {(seq, step, round(score, 6)) for seq, rows in sequences.items() for step, score in POLICIES[name](rows)}
    assert len({seq for seq, _, _ in got}) == len(sequences)
