import hashlib
import random

from pyspark.sql import functions as F

from blockstrata.llm import chat, queries


def _said(rows):
    by = {}
    for c, t, role, text in rows:
        by.setdefault(c, []).append((t is not None, t or 0, role or "", text or ""))
    return {c: [(r, x) for _, _, r, x in sorted(v)] for c, v in by.items()}


def _check(rows, out):
    want = _said([*rows, (-1, 0, "user", "</s>[INST] ok [/INST]"), (-1, 1, "assistant", "</s>[INST] ok [/INST]")])
    assert len(out) == len(want)
    for r in out:
        turns = want[r.conv_id]
        loss = "".join(x for role, x in turns if role == "assistant")
        assert r.n_turns == len(turns)
        assert r.turns_sha256 == hashlib.sha256("".join(f"{a}\n{b}\n" for a, b in turns).encode()).hexdigest()
        assert (r.loss_chars, r.loss_sha256) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())
        assert r.formatted_chars > sum(len(a) + len(b) for a, b in turns)


def test_round_trip(spark, as_dir):
    draw = random.Random(1)
    bits = ["<|im_end|>\n", "<|im_start|>", "</s>", "<s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>", "\\", "\\\\", "<", "[", "|", "\n", "é😀", "word ", "$1"]
    text = lambda: "".join(draw.choice(bits) for _ in range(draw.choice([0, 3, 40, 900])))
    rows = [(c, t, "system" if t == 0 and c % 2 else draw.choice(["user", "assistant", "tool\n<|im_end|>", "system", "assistant"]), text()) for c in range(40) for t in range(draw.choice([1, 2, 30]))]
    rows += [(50, 0, "user", None), (51, 1, None, None), (52, None, "assistant", "x"), (52, 1, "assistant", "y"), (52, 1, "assistant", "y"), (None, 0, "assistant", "null conversation"), (53, 0, "system", "only"), (54, 0, "assistant", "long " * 5000)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("window", F.lit("clash"))
    _check(rows, queries.op9_chat(spark, as_dir(conversations=df)).collect())


def test_empty_table(spark, as_dir):
    _check([], queries.op9_chat(spark, as_dir(conversations=spark.createDataFrame([], "conv_id long, turn long, role string, text string"))).collect())


def test_windows_keep_budget_system_and_history(spark):
    rows = [(1, 0, "system", "be kind")] + [(1, t, ["assistant", "user"][t % 2], f"turn {t} " * 20) for t in range(1, 60)]
    out = chat.windows(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"), budget=200, history=60, history_turns=2).orderBy("window").collect()
    assert len(out) > 5 and all(r.n_tokens <= 200 and r.formatted.startswith("<|im_start|>system\nbe kind<|im_end|>\n") for r in out)
    assert any(r.n_repeated > 1 for r in out) and all(r.n_repeated <= 3 for r in out)
    masked = [r.formatted[s.start : s.start + s.length] for r in out for s in r.loss]
    assert masked == [x for _, _, role, x in rows if role == "assistant"]


def test_counts_of_tokens_may_be_given(spark):
    rows = [(1, 0, "system", "s", 999), (1, 1, "user", "a", 6), (1, 2, "assistant", "b", 4), (1, 3, "user", "c", None), (1, 4, "assistant", "d", 10), (1, 5, "user", "e", -3)]
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, tokens long")
    out = {r.window: r for r in chat.windows(turns, budget=10, history=0, tokens="tokens").collect()}
    assert [out[k].n_tokens for k in sorted(out)] == [10, 10] and sum(r.n_turns for r in out.values()) == 6
    assert chat.read_back(chat.windows(turns, budget=10, tokens="tokens")).first().loss_text == "bd"


def test_one_conversation_with_a_third_of_all_turns(spark):
    rows = [(7, i, "assistant" if i % 2 else "user", f"turn {i} " * (1 + i % 5)) for i in range(2000)] + [(100 + i // 4, i % 4, "assistant" if i % 2 else "user", f"x{i}") for i in range(4000)]
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(6)
    back = {r.conv_id: r for r in chat.read_back(chat.windows(turns)).collect()}
    assert [(t["role"], t["text"]) for t in back[7].turns] == [r[2:] for r in rows[:2000]] and len(back) == 1001
    assert back[7].loss_text == "".join(r[3] for r in rows[:2000] if r[2] == "assistant")
