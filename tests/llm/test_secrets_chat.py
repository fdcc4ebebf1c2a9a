"""Secret scans and chat formatting against plain versions."""

import hashlib
import random
import re

from hypothesis import given, settings
from hypothesis import strategies as st

from candleframe.llm import chatfmt, secrets
from candleframe.llm.queries import QUERIES


def brute_spans(t):
    key = "(?:" + "|".join("".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in w) for w in ("password", "passwd", "secret", "token", "apikey", "api_key")) + ")"
    out = [(m.start(), 0, "assign", m.end()) for m in re.finditer(key + r"""["']? *[:=] *["']?([A-Za-z0-9+/_.=-]+)""", t) if len(m[1]) >= 8]
    out += [(m.start(), 1, "access", m.end()) for m in re.finditer("AKIA[A-Z0-9]+", t) if len(m[0]) >= 16]
    out += [(m.start(), 2, "hex", m.end()) for m in re.finditer("[0-9a-f]+", t) if len(m[0]) >= 32]
    return [(k, a, b) for a, _, k, b in sorted(out)]


def some_contents():
    rng = random.Random(3)
    parts = ["password", "Token", "API_KEY", "api key", "ſecret", "secret", "=", ":", " ", '"', "'", "abcdefgh", "short", "AKIA", "AKIA" + "B" * 12, "0123456789abcdef" * 2, "deadbeef", "é", "\n", "x"]
    return ["".join(rng.choice(parts) for _ in range(rng.randrange(14))) for _ in range(400)] + ["", "token: secret: abcdefgh12", "AKIAAKIA" + "A" * 8]


def test_spans_equal_brute_force(spark, tmp_path):
    texts = some_contents()
    df = spark.createDataFrame([(f"p{k}", t, "v") for k, t in enumerate([*texts, None])], "path string, content string, blob_digest string")
    got = secrets.scan(df, "content", str(tmp_path / "ledger")).collect()
    assert len(got) == len(texts) + 1
    for r in got:
        assert [tuple(s) for s in r.spans] == brute_spans(r.content or "") and r.blob_digest == "v"


def test_ledger_scans_unseen_pairs_only(spark, tmp_path):
    ledger = str(tmp_path / "ledger")
    frame = lambda rows: spark.createDataFrame(rows, "path string, content string")
    secrets.scan(frame([("a", "token=abcdefgh"), ("b", "token=abcdefgh"), ("c", "none")]), "content", ledger).collect()
    rows = spark.read.parquet(ledger)
    assert rows.count() == 2
    got = secrets.scan(frame([("d", "token=abcdefgh"), ("e", "new")]), "content", ledger).collect()
    assert spark.read.parquet(ledger).count() == 3 and {r.path: len(r.spans) for r in got} == {"d": 1, "e": 0}
    more = (*secrets.BASE_RULES, secrets.Rule("none", "none", 0, 1))
    got = secrets.scan(frame([("c", "none")]), "content", ledger, more).collect()
    assert spark.read.parquet(ledger).count() == 4 and [tuple(s) for s in got[0].spans] == [("none", 0, 4)]


WILD = st.lists(st.sampled_from(["</s>", "<s>", "[INST]", "[/INST]", "[SYS]", "[/TURN]", "[ROLE]", "\\", "<", "[", " ", "a", "\n", "é"]), max_size=8).map("".join)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.tuples(st.one_of(st.sampled_from(["system", "user", "assistant", ""]), WILD), WILD), max_size=5))
def test_reader_inverts_writer(turns):
    t = chatfmt.DEFAULT
    joined = "".join(s for role, text in turns for s, _ in chatfmt.segments(role, text, t, t.pattern()))
    assert list(chatfmt.read_back(joined, t)) == turns


def test_conversations(spark):
    rows = [(1, 1, "assistant", "hi"), (1, 0, "user", "yo [/INST]"), (2, 0, "assistant", "first"), (3, 0, None, None), (None, 0, "user", "q"), (4, 0, "user", "a"), (4, 0, "user", "a"), (5, 0, "tool", "\\x")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = {r.conv_id: r for r in chatfmt.digests(chatfmt.format_turns(df)).collect()}
    assert len(got) == 6 and got[1].valid and not any(got[k].valid for k in (2, 3, 4, 5))
    for conv, r in got.items():
        own = sorted((t, x or "", y or "") for c, t, x, y in rows if c == conv)
        assert r.n_turns == len(own)
        assert r.turns_sha256 == hashlib.sha256("".join(f"{x}\n{y}\n" for _, x, y in own).encode()).hexdigest()
        learned = "".join(y for _, x, y in own if x == "assistant")
        assert (r.loss_chars, r.loss_sha256) == (len(learned), hashlib.sha256(learned.encode()).hexdigest())
    assert chatfmt.digests(chatfmt.format_turns(df.limit(0))).count() == 0


def test_query_adds_the_tricky_conversation(spark):
    r = QUERIES["op7_chat_format"](spark, "/root/testdata/sf0.001").filter("conv_id = -1").collect()
    assert len(r) == 1 and r[0].n_turns == 2 and r[0].loss_chars == len("</s>[INST] ok [/INST]")
