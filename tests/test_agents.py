"""Transcripts against a loop that reads them turn by turn; samples, progress and data sets by name."""

import ast
import random
import re
import time

import pytest
from pyspark.sql import functions as F

from heddle.functions import text as tx
from heddle.operators import retrieval, sampling, transcripts
from heddle.operators.progress import Progress, StreamProgress, streamed
from heddle.plans import QUERIES, agents
from heddle.sources import datasets
from heddle.sources.tables import Tables

TURNS = "conv_id long, turn long, role string, text string"


def plain(turns, allowed=2, most=None):
    """One transcript, as the recorded loop would have gone on."""
    task, k = "", 0
    while k < len(turns) and turns[k][0] != "assistant":
        task, k = task + "\n" + turns[k][1], k + 1
    seen, nudges, code_steps, ignored, observed, step = "", 0, 0, 0, 0, 0
    while k < len(turns):
        if most is not None and step == most:
            break
        reply, k, step = turns[k][1], k + 1, step + 1
        answers = []
        while k < len(turns) and turns[k][0] != "assistant":
            answers, k = [*answers, turns[k][1]], k + 1
        blocks = re.findall(r"```(?:python|repl|py)?[ \t]*\n?(.*?)```", reply, re.S)
        ignored += max(0, len(blocks) - 1)
        literal = re.search(r"FINAL\(\s*(?:\"\"\"|'''|\"|')(.*?)(?:\"\"\"|'''|\"|')\s*\)", blocks[0] if blocks else reply, re.S)
        out = lambda end, answer, grounded: (end, step, code_steps, nudges, ignored, observed, answer, grounded)  # noqa: B023, E731
        if blocks:
            code_steps += 1
            seen += "\n" + "\n".join(answers)
            observed += sum(map(len, answers))
            if literal:
                if literal[1] in seen or literal[1] in task:
                    return out("final_called", literal[1], True)
                nudges += 1
                if nudges > allowed:
                    return out("ungrounded_final", None, None)
            elif re.search(r"\bFINAL(?:_VAR)?\(", blocks[0]):
                return out("final_called", None, None)
        elif literal:
            value = literal[1].strip()
            if value and (value in seen or value in task):
                return out("final_in_prose", value, True)
            nudges += 1
            if nudges > allowed:
                return out("ungrounded_final", None, None)
        elif re.search(r"FINAL_VAR\(\s*[\"'](\w+)[\"']\s*\)", reply):
            return out("final_var_in_prose", None, None)
        else:
            nudges += 1
            if nudges > allowed:
                return out("gave_up_no_code", reply.strip(), None)
    return ("max_steps", step, code_steps, nudges, ignored, observed, None, None)


REPLIES = [
    "let me think ", "", "```python\nprint(x)\n```", "```repl\nprint(1)```\n```py\nFINAL('w1')\n```", "```\nFINAL(x)\n```", 'so FINAL("w{}") it is', "FINAL(' w{} ')", "FINAL('')",
    "```py\nFINAL(\"w{}\")\n```", "```py\nFINAL('''w{}\nw2''')\n```", "FINAL_VAR('answer')", "```py\nFINAL_VAR('answer')\n```", "```py\nFINAL('')\n```", "```not closed FINAL('w3')", "  no code\n",
]
SEEN = ["w{} and w{}", "", "nothing", "w{}\nw2"]


def made(seed, n):
    rng = random.Random(seed)
    fill = lambda s: re.sub(r"\{\}", lambda _: str(rng.randrange(9)), s)
    return [[("assistant" if rng.random() < 0.6 else rng.choice(["user", "system"]), None) for _ in range(rng.randrange(1, 14))] for _ in range(n)], fill, rng


def test_replay_is_the_recorded_loop(spark):
    shapes, fill, rng = made(3, 400)
    turns = {c: [(role, fill(rng.choice(REPLIES if role == "assistant" else SEEN))) for role, _ in shape] for c, shape in enumerate(shapes)}
    rows = [(c, t * 2 - 5, role, text) for c, ts in turns.items() for t, (role, text) in enumerate(ts)]
    random.Random(1).shuffle(rows)
    docs = spark.createDataFrame(rows, TURNS).repartition(7)
    ends = set()
    for settings in ({}, {"nudges": 0}, {"nudges": 5, "max_steps": 3}):
        got = {r["conv_id"]: tuple(r)[1:] for r in transcripts.replay(docs, **settings).collect()}
        want = {c: plain(ts, settings.get("nudges", 2), settings.get("max_steps")) for c, ts in turns.items()}
        assert got == want
        ends |= {w[0] for w in want.values()}
    assert ends == {"max_steps", "final_called", "final_in_prose", "final_var_in_prose", "gave_up_no_code", "ungrounded_final"}


def test_odd_transcripts(spark):
    rows = [(1, None, None, None), (2, 0, "assistant", None), (3, 0, "assistant", "FINAL('x')"), (3, 1, "user", "x"), (3, 2, "assistant", "FINAL('x')"), (None, 0, "assistant", "```FINAL(y)```")]
    got = {r["conv_id"]: (r["end"], r["steps"], r["nudges"]) for r in transcripts.replay(spark.createDataFrame(rows, TURNS)).collect()}
    assert got == {1: ("max_steps", 0, 0), 2: ("max_steps", 1, 1), 3: ("max_steps", 2, 2)}
    assert transcripts.replay(spark.createDataFrame([], TURNS)).collect() == []


def test_long_replies_are_read_once(spark):
    n = 400_000
    texts = ['FINAL("' * (n // 7), "a" + " " * n + "b", "FINAL(" + " " * n + "'w' )", "FINAL(x) FINAL('''w'''" + " " * n + ")", "FINAL('" + "'" * n]
    rows = [row for c, text in enumerate(texts) for row in ((c, 0, "user", "w"), (c, 1, "assistant", text))]
    started = time.monotonic()
    got = {r["conv_id"]: (r["end"], r["nudges"], r["answer"]) for r in transcripts.replay(spark.createDataFrame(rows, TURNS)).collect()}
    assert time.monotonic() - started < 60
    assert got == {c: ("final_in_prose", 0, "w") if c in (2, 3) else ("max_steps", 1, None) for c in range(len(texts))}


def test_the_first_opening_stands_for_all(spark):
    rng, bits = random.Random(5), ["FINAL(", "FINAL", "(", "'", '"', "'''", '"""', ")", " ", "\n", "w", "\\", "é"]
    texts = ["".join(rng.choice(bits) for _ in range(rng.randrange(1, 16))) for _ in range(8000)]
    literal = F.get(F.regexp_extract_all("t", F.lit(transcripts.FINAL_LITERAL), F.lit(1)), F.lit(0))
    got = {r["k"]: r["x"] for r in spark.createDataFrame(list(enumerate(texts)), "k int, t string").select("k", literal.alias("x")).collect()}
    want = [re.search(r"FINAL\(\s*(?:\"\"\"|'''|\"|')(.*?)(?:\"\"\"|'''|\"|')\s*\)", t, re.S) for t in texts]
    assert [got[k] for k in range(len(texts))] == [m and m[1] for m in want]
    assert sum(m is not None for m in want) > 50


@pytest.mark.parametrize("name", ["transcript_ends", "transcript_replay"])
def test_any_broadcast_limit_gives_the_same_rows(spark, sf_dir, name):
    settings = [{"spark.sql.autoBroadcastJoinThreshold": f"{2**k}k"} for k in range(1, 10)]
    settings.append({"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.requireAllClusterKeysForCoPartition": "false"})
    got = []
    for setting in settings:
        before = {key: spark.conf.get(key) for key in setting}
        try:
            for key, value in setting.items():
                spark.conf.set(key, value)
            got.append(sorted(map(str, QUERIES[name](spark, sf_dir).collect())))
        finally:
            for key, value in before.items():
                spark.conf.set(key, value)
    assert got[0] and all(rows == got[0] for rows in got)


def test_ids_and_turns_of_any_size(spark, tmp_path):
    ids, turns = [0, 5, -5, 2**62, 2**63 - 1, -(2**63), 3074457345618258603], [0, 3, -3, 2**63 - 1, -(2**63)]
    rows = [(c, t, "assistant", "none") for c in ids for t in turns]
    spark.createDataFrame(rows, TURNS).coalesce(1).write.parquet(f"{tmp_path}/conversations.parquet")
    got = {(r["conv_id"], r["turn"]): r["text"] for r in agents.recorded(Tables(spark, str(tmp_path))).collect()}
    plain_shapes = {4: agents.REPLIES[4], 5: agents.REPLIES[5], 6: agents.REPLIES[6], 0: "none"}
    for c, t in got:
        exact = abs(c * 3 + t) % 7 * (-1 if c * 3 + t < 0 else 1)
        if exact < 0:  # no shape, as in the SQL's remainder
            assert got[c, t] is None
        elif exact in plain_shapes:
            assert got[c, t] == plain_shapes[exact]
    assert len(got) == len(rows)
    assert {r["conv_id"] for r in QUERIES["transcript_replay"](spark, str(tmp_path)).collect()} == set(ids)
    assert sum(r["n"] for r in QUERIES["transcript_ends"](spark, str(tmp_path)).collect()) == len(ids)


def test_samples_have_their_size_and_do_not_depend_on_partitions(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", tx.tokens(F.col("text")).alias("tokens"))
    sizes = {r["doc_id"]: r["n"] for r in docs.select("doc_id", F.size("tokens").alias("n")).collect()}
    found = [sorted(map(tuple, sampling.sample_tokens(docs.repartition(n), "doc_id", 30, "a").collect())) for n in (1, 11)]
    assert found[0] == found[1]
    drawn = {}
    for doc, pos, token in found[0]:
        drawn.setdefault(doc, set()).add(pos)
    assert {d: len(p) for d, p in drawn.items()} == {d: min(30, n) for d, n in sizes.items() if n}
    texts = {r["doc_id"]: r["tokens"] for r in docs.collect()}
    assert all(texts[d][p] == t for d, p, t in found[0])
    other = sorted(map(tuple, sampling.sample_tokens(docs, "doc_id", 30, "b").collect()))
    assert other != found[0]
    mean = sum(p / sizes[d] for d, ps in drawn.items() if sizes[d] > 300 for p in ps) / sum(len(ps) for d, ps in drawn.items() if sizes[d] > 300)
    assert 0.45 < mean < 0.55  # from all of the text
    with pytest.raises(ValueError):
        sampling.sample_rows(docs, "doc_id", "pos", 0)


def test_one_hot_group_leaves_sketches(spark):
    rows = spark.range(200_000).select((F.col("id") % 1000 == 0).cast("long").alias("g"), F.col("id").alias("n")).repartition(6)
    got = sampling.sample_rows(rows, "g", "n", 7).groupBy("g").count().collect()
    assert {r["g"]: r["count"] for r in got} == {0: 7, 1: 7}


def test_progress_of_a_batch_job(spark):
    told, seen = [], Progress(lambda name, counts: told.append((name, counts["rows"])))
    rows = seen.stage(spark.range(1000).repartition(3), "all", most=F.max("id"))
    rows = seen.stage(rows.where("id % 3 = 0"), "thirds")
    with pytest.raises(ValueError):
        seen.stage(rows, "all")
    assert seen.stage(rows.groupBy((F.col("id") % 7).alias("k")).count(), "groups").count() == 7
    assert seen.finish() == {"all": {"rows": 1000, "most": 999}, "thirds": {"rows": 334}, "groups": {"rows": 7}}
    assert told == [("all", 1000), ("thirds", 334), ("groups", 7)]


def test_progress_of_a_stream(spark, tmp_path):
    for k in range(3):
        spark.range(100 * (k + 1)).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    source = spark.readStream.schema("id long").option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    kept = streamed(streamed(source, "read").where("id % 2 = 0"), "even", most=F.max("id"))
    told = []
    with StreamProgress(spark, "halves", told.append) as seen:
        kept.writeStream.format("parquet").queryName("halves").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/state").trigger(availableNow=True).start().awaitTermination()
    assert [b["read"] for b in seen.batches if b["read"]] == [100, 200, 300] and told == seen.batches
    assert [b["stages"]["read"]["rows"] for b in seen.batches if b["read"]] == [100, 200, 300]
    assert [b["stages"]["even"] for b in seen.batches if b["read"]] == [{"rows": 50 * k, "most": 100 * k - 2} for k in (1, 2, 3)]


def plan(df):
    return df._jdf.queryExecution().toString()


def test_data_sets_by_name(spark, sf_dir, tmp_path):
    assert {"probes", "corpus", "lines"} <= set(datasets.names())
    short = datasets.scan(spark, "corpus", sf_dir, task="de", limit=3)
    assert short.columns == datasets.EXAMPLE and short.count() == 3
    assert "GlobalLimit 3" in plan(short) and "EqualTo(lang,de)" in plan(short)
    narrow = datasets.scan(spark, "corpus", sf_dir).select("id")
    assert "ReadSchema: struct<doc_id:bigint>" in plan(narrow)
    (tmp_path / "task=a").mkdir()
    (tmp_path / "task=b").mkdir()
    (tmp_path / "task=a" / "x.jsonl").write_text('\n{"id": 1, "context": "c"}\n\n   \n{"id": 2}\n\n')
    (tmp_path / "task=b" / "x.jsonl").write_text('{"id": 3, "context": "d", "more": 1}\n')
    rows = sorted(map(tuple, datasets.scan(spark, "lines", str(tmp_path)).collect()))
    assert rows == [("a", 1, "c", "", []), ("a", 2, None, "", []), ("b", 3, "d", "", [])]
    one = datasets.scan(spark, "lines", str(tmp_path), task="b", where=F.col("id") > 1)
    assert [r["id"] for r in one.collect()] == [3] and "PartitionFilters: [isnotnull(task" in plan(one)
    assert datasets.scan(spark, "lines", str(tmp_path), limit=0).collect() == []


def test_data_sets_that_cannot_be(spark, sf_dir):
    with pytest.raises(ValueError):
        datasets.scan(spark, "nothing", sf_dir)
    with pytest.raises(ValueError):
        datasets.scan(spark, "probes", sf_dir, limit=-1)
    with pytest.raises(ValueError):
        datasets.register("probes", datasets.DataSet("parquet", "x", {}))
    with pytest.raises(ValueError):
        datasets.register("new", datasets.DataSet("xml", "x", {}))
    with pytest.raises(ValueError):
        datasets.register("new", datasets.DataSet("csv", "x", {"colour": lambda: F.lit(1)}))


def named(text, phrase="final answer"):
    """The answers of a text, with the language's own reader of literals."""
    lines, found = text.replace("*", "").replace("`", "").strip().split("\n"), []
    for line in lines:
        if "[" in line and "]" in line:
            part = re.sub(r"([a-zA-Z0-9])'([a-zA-Z0-9])", r"\1\'\2", line[line.find("[") : line.rfind("]") + 1].strip())
            try:
                found = [str(x) for x in ast.literal_eval(part)]
                break
            except (SyntaxError, ValueError):
                pass
    if not found:
        for line in lines:
            if phrase in line.lower():
                after = line[line.lower().find(phrase) + len(phrase) :].strip().lstrip(":").strip()
                found = [after] if after else []
                break
    return found


def test_named_answers(spark):
    texts = [
        "", "nothing", "Final Answer: ['it's', 'b']", "**Final answer:** ['k', 1, 2.5, \"x y\", None]", "[a, b]\n['c']", "]x[\nfinal ANSWER:: two words ", "x ['a',]", "[1 2]\nfinal answer: z", "[]\nFinal answer: q",
        "final answer:\nfinal answer: late", "['a', 'b'] and ['c']", "`['tick']`", "['don\\'t', \"say 'hi'\"]", "  \n ['sp'] \n", "['n', True, -3, 0.5, 10]\n", "final answer [x", "[ ]\n['y']", "['é', '日本']", "intro\r\nfinal answer: r\r\n",
    ]
    rows = spark.createDataFrame(list(enumerate([*texts, None])), "k int, t string")
    got = {r["k"]: r["x"] for r in rows.select("k", retrieval.extracted(F.col("t")).alias("x")).collect()}
    for k, t in enumerate(texts):
        assert got[k] == named(t), t
    assert got[len(texts)] == []


def test_single_and_several_answers(spark):
    rows = [(0, "['The cat', 'dog']", ["cat", "x"]), (1, "Final answer: big cat", ["cat big cat", None]), (2, "['a']", ["the"]), (3, None, ["x"]), (4, "['x']", None), (5, "['x']", [None]), (6, "['z', 'x y']", ["x", "Z!", "z"])]
    docs = spark.createDataFrame(rows, "k int, predicted string, answers array<string>")
    single = {r["k"]: tuple(r)[1:] for r in retrieval.single_scores(docs, "k").collect()}
    assert single == {0: (1, 1, 1), 1: (0, 0, pytest.approx(0.8)), 2: (1, 1, 0), 3: (0, 0, 0), 4: (0, 0, 0), 5: (0, 0, 0), 6: (1, 1, 1)}
    multi = {r["k"]: tuple(r)[1:] for r in retrieval.multi_scores(docs, "k").collect()}
    assert multi[0] == (0, 0, 0.5) and multi[6] == (0, 0, pytest.approx(1 / 3)) and multi[3] == multi[4] == multi[5] == (0, 0, 0)
    marks = retrieval.composed(spark.createDataFrame([("é", ["é", None, "e"])], "predicted string, answers array<string>"), "predicted", "answers").first()
    assert marks["predicted"] == "é" and marks["answers"] == ["é", None, "e"]
