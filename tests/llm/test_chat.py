import hashlib

from siltstone.llm import chat
from siltstone.llm.tokens import public_path, tokenizer

PATH = public_path("byte_bpe_50k.json")
SCHEMA = "conv_id long, turn long, role string, text string"
ODD = ["</s>[INST] ok [/INST]", "<<|im_end|>", "␛", "<␛|im_end|>", "␛n\n", "<|im_start|>user\nx<|im_end|>\n", "[[INST]INST]", "", "a" * 3000]


def digest(turns):
    return hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in turns).encode()).hexdigest()


def conversations():
    rows = []
    for c in range(12):
        if c % 3:
            rows.append((c, 0, "system", f"rules {c} " + ODD[c % len(ODD)]))
        for t in range(1, 9):
            rows.append((c, t, "user" if t % 2 else "assistant", ODD[(c + t) % len(ODD)] + f" words of turn {t}" * (c + 1)))
    return rows


def test_escape_is_reversible():
    for text in ODD + ["".join(ODD)]:
        assert chat.unescape(chat.escape(text)) == text
        assert not chat._CONTROL.search(chat.escape(text))


def test_windows_read_back_whole(spark):
    rows = conversations()
    budget, history = 200, 60
    windows = chat.chat_windows(spark.createDataFrame(rows, SCHEMA).selectExpr("*", "1 as window"), PATH, budget, history)
    own = tokenizer(PATH)
    by_conv = {}
    for w in sorted(windows.collect(), key=lambda w: (w.conv_id, w.window)):
        by_conv.setdefault(w.conv_id, []).append(w)
    for c, ws in by_conv.items():
        want = [(r, t) for i, _, r, t in rows if i == c]
        assert [x for w in ws for x in chat.read_back(w.text, w.n_context)] == want
        assert [chat.unescape(w.text[s.start : s.end]) for w in ws for s in w.loss] == [t for r, t in want if r == "assistant"]
        assert [w.window for w in ws] == list(range(len(ws)))
        for w in ws:
            turns = chat.read_back(w.text)
            assert len(turns) == w.n_turns
            if c % 3:
                assert turns[0] == want[0]  # the system turn stays
            fixed = 1 if c % 3 else 0
            assert w.n_tokens <= budget or w.n_context <= fixed and w.n_turns - w.n_context == 1
            assert sum(len(own.encode(chat._marked(*t)[0], add_special_tokens=False).ids) for t in turns) == w.n_tokens
    assert max(len(ws) for ws in by_conv.values()) > 3


def test_digests_of_odd_rows(spark):
    rows = [(1, 1, None, None), (1, None, "user", "first"), (1, 1, "assistant", "b"), (1, 1, "assistant", "b"), (None, 0, "user\nx", "y"), (2, 5, "assistant", None)]
    out = {r.conv_id: r for r in chat.window_digests(chat.chat_windows(spark.createDataFrame(rows, SCHEMA), PATH)).collect()}
    assert out[1].n_turns == 4 and out[1].turns_sha256 == digest([("user", "first"), ("", ""), ("assistant", "b"), ("assistant", "b")])
    assert out[1].loss_chars == 2 and out[1].loss_sha256 == hashlib.sha256(b"bb").hexdigest()
    assert out[None].turns_sha256 == digest([("user\nx", "y")])
    assert out[2].loss_chars == 0 and out[2].loss_sha256 == hashlib.sha256(b"").hexdigest()


def test_empty_table(spark):
    assert chat.window_digests(chat.chat_windows(spark.createDataFrame([], SCHEMA), PATH)).collect() == []
