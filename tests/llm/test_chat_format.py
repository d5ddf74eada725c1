"""Chat windows: exact round trip, budget, history and loss."""

import hashlib
import random

from paperloom.llm import chat_format as C
from paperloom.llm import queries, tokens


def test_template_round_trip():
    rng = random.Random(3)
    bits = ["\\", "<", ">", "\n", "</turn>", "<turn user>\n", "a", "é", "", "\\<", "<\\", "\\n", "\\0", "### Assistant:"]
    for _ in range(3000):
        turns = [("".join(rng.choices(bits, k=rng.randrange(3))), "".join(rng.choices(bits, k=rng.randrange(6)))) for _ in range(rng.randrange(1, 5))]
        text = "".join(C.render(r, t)[0] for r, t in turns)
        got = C.parse(text)
        assert [(r, t) for r, t, _, _ in got] == turns
        assert [C.unescape(text[a:b]) for _, _, a, b in got] == [t for _, t in turns]


def test_query(spark, sf):
    rows = spark.read.parquet(f"{sf}/conversations.parquet").collect()
    talk = {}
    for r in sorted(rows, key=lambda r: (r.conv_id, r.turn)):
        talk.setdefault(r.conv_id, []).append((r.role, r.text or ""))
    talk[-7] = [("user", "\\### Assistant: </turn> ok"), ("assistant", "\\### Assistant: </turn> ok")]
    got = {r.conv_id: r for r in queries.op8_chat_format(spark, sf).collect()}
    assert got.keys() == talk.keys()
    for c, turns in talk.items():
        loss = "".join(t for r, t in turns if r == "assistant")
        assert (got[c].n_turns, got[c].turns_sha256) == (len(turns), hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in turns).encode()).hexdigest())
        assert (got[c].loss_chars, got[c].loss_sha256) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())
        assert got[c].formatted_chars > loss.count("")


def test_windows(spark):
    words = lambda n, k: " ".join(f"w{k}" for _ in range(n))
    turns = [("system", "be kind")] + [("user" if i % 2 else "assistant", words(20 + 13 * i % 90, i)) for i in range(40)] + [("user", words(900, 99))]
    df = spark.createDataFrame([(1, i, r, t) for i, (r, t) in enumerate(turns)], "conv_id long, turn long, role string, text string")
    got = C.format_windows(df, budget=300, history=120).collect()
    ids = tokens.encoder(tokens.default_path())
    assert len(got) > 5 and [w.window for w in got] == list(range(len(got)))
    for w in got:
        parsed = C.parse(w.text)
        assert parsed[0][:2] == ("system", "be kind")
        sizes = [len(ids(C.render(r, t)[0])) for r, t, _, _ in parsed]
        assert sum(sizes) == w.n_tokens and (w.n_tokens <= 300 or w.over and len(parsed) == 2)
        assert sum(sizes[1 : w.n_repeated]) <= 120
        assert len(w.loss) == sum(r == "assistant" for r, *_ in parsed[w.n_repeated :])
    assert sum(w.n_repeated > 1 for w in got) > 3
    new = [p[:2] for w in got for p in C.parse(w.text)[w.n_repeated :]]
    assert new == turns[1:]


def test_odd_rows(spark):
    rows = [(None, 0, "user", "hi"), (1, None, None, None), (1, 0, "assistant", ""), (1, 0, "assistant", ""), (2, 0, "system", "only"), (3, 1, "a>b\nc<", "x" * 50_000), (3, 1, "a", "tie")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").selectExpr("*", "1 as window", "'z' as loss")
    got = {r.conv_id: r for r in C.read_back(C.format_windows(df)).collect()}
    assert {k: v.n_turns for k, v in got.items()} == {None: 1, 1: 3, 2: 1, 3: 2}
    assert got[3].turns_sha256 == hashlib.sha256(f"a\ntie\na>b\nc<\n{'x' * 50_000}\n".encode()).hexdigest()
    assert C.read_back(C.format_windows(df.limit(0))).count() == 0
