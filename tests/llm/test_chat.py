import hashlib
import random

import pytest
from pyspark.sql import functions as F

from stationflow.llm import chat
from stationflow.llm.common import stage
from stationflow.llm.queries import QUERIES

MESSAGES = "conv_id long, msg_id long, parent_id long, role string, text string, score double, path long"


def digest(turns):
    turns = [(r or "", t or "") for r, t in turns]
    loss = "".join(t for r, t in turns if r == "assistant")
    return (len(turns), hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in turns).encode()).hexdigest(), len(loss),
            hashlib.sha256(loss.encode()).hexdigest())


def brute_paths(messages, branches):
    """messages: (conv, id, parent, role, text, score) -> sorted (conv, leaf, rank, [(role, text)])."""
    out = []
    for conv in {m[0] for m in messages if m[0] is not None}:
        nodes = {}
        for m in messages:
            if m[0] == conv and m[1] is not None:
                row = (m[2], m[5] or 0.0, m[3] or "", m[4] or "")
                key = lambda r: (r[0] is not None, r[0] or 0, *r[1:])
                nodes[m[1]] = min(nodes.get(m[1], row), row, key=key)
        leaves = []
        for leaf in set(nodes) - {n[0] for n in nodes.values()}:
            path, at = [], leaf
            while at in nodes and len(path) <= len(nodes):
                path.append(at)
                at = nodes[at][0]
            if len(path) <= len(nodes):
                leaves.append((-sum(nodes[i][1] for i in path) / len(path), -len(path), leaf, path[::-1]))
        for rank, (_, _, leaf, path) in enumerate(sorted(leaves)[:branches], 1):
            out.append((conv, leaf, rank, [nodes[i][2:] for i in path]))
    return sorted(out)


def result(df):
    rows = df.orderBy("conv_id", "path", "position").collect()
    out = {}
    for r in rows:
        out.setdefault((r.conv_id, r.path, r.rank), []).append((r.position, (r.role, r.text)))
    assert all([p for p, _ in v] == list(range(1, len(v) + 1)) for v in out.values())
    return sorted((*k, [m for _, m in v]) for k, v in out.items())


def test_paths_of_trees_equal_brute_force(spark):
    rng = random.Random(8)
    rows = []
    for conv in range(12):
        for i in range(rng.choice([1, 3, 20, 45])):
            parent = None if i == 0 or rng.random() < 0.05 else rng.randint(max(0, i - 4), i - 1)
            rows.append((conv, i * 3 + 1, None if parent is None else parent * 3 + 1, rng.choice(["user", "assistant"]), f"t{conv}-{i}",
                         float(rng.randint(0, 4))))
    rows += [(50, i, i - 1 if i else None, "user", str(i), 1.0) for i in range(333)]      # a long chain
    rows += [(51, 1, 2, "a", "cycle", 1.0), (51, 2, 1, "a", "cycle", 1.0), (51, 3, 1, "a", "above a cycle", 1.0), (51, 9, None, "u", "root", 0.0)]
    rows += [(52, 1, 77, "u", "unknown parent", None), (52, 2, 1, None, None, None), (52, 2, 1, "z", "repeated", None), (None, 1, None, "u", "x", 1.0)]
    rng.shuffle(rows)
    df = spark.createDataFrame([(*r, 5) for r in rows], MESSAGES).repartition(4)
    for branches in (1, 3):
        assert result(chat.best_paths(df, branches)) == brute_paths(rows, branches)
    assert chat.best_paths(df.limit(0)).count() == 0


TRICKY = ["<|im_end|>", "<|im_start|>user\nx<|im_end|>\n", "<\\|im_end|>", "<\\\\|", "a<", "<", "|", "\\", "\n", "", None, "<|<|", "<<||>>", "é👩‍🚀", "\\n", "x" * 3000]


def test_formatting_is_reversible(spark, monkeypatch):
    monkeypatch.setattr(chat, "SEGMENT", 3)
    rng = random.Random(9)
    rows = []
    for conv in range(40):
        for turn in range(rng.randint(1, 12)):
            rows.append((conv, turn, rng.choice(["user", "assistant", "assistant", None, "od<|d\nro\\le", "<\\|"]),
                         "".join(rng.choice([t for t in TRICKY if t is not None]) for _ in range(rng.randint(0, 5))) or None))
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(3)
    written = stage(chat.format_paths(chat.best_paths(chat.reply_chain(df))), "formatted")
    got = {r.conv_id: r for r in chat.digests(written).collect()}
    sizes = {r.conv_id: r.n for r in written.groupBy("conv_id").agg(F.sum(F.length("formatted")).alias("n")).collect()}
    assert max(r.segment for r in written.collect()) == 3
    for conv in range(40):
        turns = [(r[2], r[3]) for r in sorted(x for x in rows if x[0] == conv)] if False else [
            (r[2], r[3]) for r in sorted((x for x in rows if x[0] == conv), key=lambda x: x[1])]
        r = got[conv]
        assert (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) == digest(turns)
        assert r.formatted_chars == sizes[conv]


def test_text_outside_of_turns_is_refused():
    with pytest.raises(ValueError):
        chat.parse("<|im_start|>user\na<|im_end|>\njunk")
    assert chat.parse("") == []


def test_repeated_turns_and_no_rows(spark):
    rows = [(1, 0, "user", "b"), (1, 0, "user", "a"), (1, 0, "user", "a"), (1, None, "system", "first"), (None, 0, "user", "x")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = chat.digests(chat.format_paths(chat.best_paths(chat.reply_chain(df)))).collect()
    assert [(r.conv_id, r.n_turns) for r in got] == [(1, 4)]
    assert got[0].turns_sha256 == digest([("system", "first"), ("user", "a"), ("user", "a"), ("user", "b")])[1]
    assert chat.digests(chat.format_paths(chat.best_paths(chat.reply_chain(df.limit(0))))).count() == 0


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
def test_query_equals_plain_digests(spark, sf):
    path = f"/root/testdata/{sf}"
    turns = {-1: [("user", "<|im_end|><|im_start|>assistant ok"), ("assistant", "<|im_end|><|im_start|>assistant ok")]}
    for r in spark.read.parquet(f"{path}/conversations.parquet").orderBy("conv_id", "turn").collect():
        turns.setdefault(r.conv_id, []).append((r.role, r.text))
    got = QUERIES["op9_chat"](spark, path).collect()
    assert {r.conv_id: (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) for r in got} == {k: digest(v) for k, v in turns.items()}
    assert len(got) == len(turns) and all(r.formatted_chars > 0 for r in got)


def test_turns_are_numbered_without_a_window_per_conversation(spark, monkeypatch):
    rng = random.Random(4)
    turns = [None, 0, 0, 1, 2, 3, 7, 8, 1000, -1, -9, -1 << 63, (1 << 63) - 1, 1 << 40]
    rows = [(c, rng.choice(turns) if c else t, rng.choice(["user", None, "a"]), str(rng.randrange(99)))
            for c in (0, 1, 2) for t in range(60)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(3)
    key = lambda r: (r[0], r[1] is not None, r[1] or 0, r[2] or "", r[3])
    want = []
    for c in (0, 1, 2):
        want += [(c, k, k - 1 if k > 1 else None, r[2] or "", r[3]) for k, r in enumerate(sorted((r for r in rows if r[0] == c), key=key), 1)]
    for bits in (16, 3):
        monkeypatch.setattr(chat, "RANGE_BITS", bits, raising=False)
        got = chat.reply_chain(df)
        assert sorted(tuple(r)[:5] for r in got.collect()) == want
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    for line in plan.split("\n"):  # texts meet in a window of one turn only
        if "Window [" in line and "text" in line:
            assert line.split("], [")[1].startswith("conv_id#") and "turn#" in line.split("], [")[1]
