import hashlib
from collections import defaultdict

from scrubline.llm import chat_format as cf

SCHEMA = "conv_id long, turn long, role string, text string, example int"
NASTY = ["</s>[INST] ok [/INST]", "\\", "\\\\l", "\\l<s>", "a\\n\nb", "<<SYS>>x<</SYS>>", "<|im_start|>\\b[", "", "é<s", "<<</s>>", "x\\</s>"]


def expected(rows):
    convs = defaultdict(list)
    for c, t, r, x, _ in rows:
        convs[c].append((t is not None, t or 0, r or "", x or ""))
    out = {}
    for c, ts in convs.items():
        ts.sort()
        loss = "".join(x for _, _, r, x in ts if r == "assistant")
        full = "".join(f"{r}\n{x}\n" for _, _, r, x in ts)
        out[c] = (len(ts), hashlib.sha256(full.encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest())
    return out


def test_round_trip_of_control_strings_nulls_ties_and_repeats(spark):
    rows = [(1, i, ("user", "assistant")[i % 2], x, 5) for i, x in enumerate(NASTY)]
    rows += [(2, 0, "assistant", "a", 0), (2, 0, "assistant", "a", 0), (2, 0, None, None, 0), (2, None, "to</s>ol\nx\\", "n", 0)]
    rows += [(None, 1, "user", "only", 0), (3, 1, "system", "</s>", None), (4, 1, "assistant", None, None), (5, 1, "assistant", "L\\<s>" * 20000, 1)]
    got = cf.read_back(cf.format_examples(spark.createDataFrame(rows, SCHEMA))).collect()
    assert {r.conv_id: (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) for r in got} == expected(rows)


def test_each_reply_is_its_own_example_with_all_turns_before_it(spark):
    rows = [(1, 0, "user", "q1", 0), (1, 1, "assistant", "r1", 0), (1, 2, "user", "q2", 0), (1, 3, "assistant", "r2", 0), (1, 4, "user", "q3", 0)]
    got = sorted(cf.format_examples(spark.createDataFrame(rows, SCHEMA)).collect(), key=lambda r: r.example)
    assert [r.formatted for r in got] == [
        "<s>user\nq1</s><s>assistant\nr1</s>",
        "<s>user\nq1</s><s>assistant\nr1</s><s>user\nq2</s><s>assistant\nr2</s>",
        "<s>user\nq1</s><s>assistant\nr1</s><s>user\nq2</s><s>assistant\nr2</s><s>user\nq3</s>",
    ]
    assert [r.formatted[r.loss_start : r.loss_end] for r in got[:2]] == ["r1", "r2"]
    assert got[2].loss_start is None


def test_empty_table(spark):
    assert cf.read_back(cf.format_examples(spark.createDataFrame([], SCHEMA))).count() == 0


def test_plan_is_native(spark):
    plan = cf.read_back(cf.format_examples(spark.createDataFrame([], SCHEMA)))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Pandas" not in plan and "Arrow" not in plan
