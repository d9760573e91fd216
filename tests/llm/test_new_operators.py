"""Conversation repair, license scans and cross-tokenizer alignment against plain versions on small tables."""

import hashlib
import random
import re
import zlib
from collections import Counter
from itertools import product

import pytest
import sentencepiece
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from floorlake.llm import alignment, licenses, repair

TURNS = "conv_id long, turn long, role string, text string, cost string, part string, extra int"


# conversation repair


def plain_audit(rows):
    """(cost, audit) by trying, row after row, every edit from every state and keeping the least of each state."""
    step = lambda s: "a" if s == "u" else "u"
    best = {"": (0, "")}

    def inserts(best):
        out = dict(best)
        for s, (c, a) in best.items():
            for k in (1, 2):
                t = step(s) if k == 1 else step(step(s))
                out[t] = min(out.get(t, (10**9, "")), (c + 5 * k, a + "I" * k))
        return out

    for initial, fault in rows:
        after = {}
        put = lambda s, c, a: after.__setitem__(s, min(after.get(s, (10**9, "")), (c, a)))  # noqa: E731, B023
        for s, (c, a) in inserts(best).items():
            put(s, c + 2, a + "D")
            if fault not in ("blank", "duplicate"):
                late = 5 if fault == "truncated" else 0
                put(step(s), c + 1 + late, a + "R")
                if initial == "s" and s == "":
                    put("s", c + late, a + "K")
                elif initial == step(s):
                    put(step(s), c + late, a + "K")
        best = after
    return min(inserts(best)[s] for s in inserts(best) if s in ("", "a"))


def plain_repair(rows):
    """Per conversation, from rows (conv_id, turn, role, text) in order."""
    out = {}
    for conv in {r[0] for r in rows}:
        own = sorted((r for r in rows if r[0] == conv), key=lambda r: (r[1] is not None, r[1] or 0))
        seen, found = set(), []
        for _, turn, role, text in own:
            role, text = " " if role is None else role, " " if text is None else text
            words = re.sub(r"[\x20\x09-\x0D]+", "", text)
            fault = "blank" if not words else "duplicate" if (role, text) in seen else "truncated" if words[-1] not in ".!?" else ""
            seen.add((role, text))
            found.append((turn, role[:1] or " ", fault, role, text))
        turns = [f[0] for f in found if f[0] is not None]
        cost, audit = plain_audit([f[1:3] for f in found])
        said, state, i = [], "", 0
        for e in audit:
            name = "assistant" if state == "u" else "user"
            if e == "D":
                i += 1
                continue
            if e == "I":
                said.append(name + ":")
            else:
                said.append((found[i][3] if e == "K" else name) + ":" + found[i][4])
                i += 1
            state = "s" if e == "K" and found[i - 1][1] == "s" else name[0]
        faults = Counter(f[2] for f in found)
        illegal = sum(a[1] + b[1] not in ("su", "ua", "au") for a, b in zip(found, found[1:]))
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        out[conv] = (gaps, faults["blank"], faults["duplicate"], faults["truncated"], illegal, cost, audit, hashlib.sha256("\n".join(said).encode()).hexdigest())
    return out


def repaired(df):
    return {r["conv_id"]: tuple(r)[1:] for r in df.collect()}


def some_turns(r, n_convs, longest):
    rows = []
    for conv in range(n_convs):
        for turn in range(r.randint(1, longest)):
            role = r.choice(["user", "assistant"] if r.random() < 0.7 else ["system", "tool", None, "", "user", "assistant"])
            rows.append((conv, turn * r.randint(1, 2) if r.random() < 0.1 else turn, role, r.choice(["Fine.", "Cut off", "So?", " ", "", None, f"Text {r.randint(0, 99)}!", f"more {turn}"])))
    # rows that share a turn are in no fixed order, so one stays
    return list({(c, t): (c, t, role, text) for c, t, role, text in rows}.values())


def test_search_against_trying_everything():
    for initials in product("sua", repeat=4):
        for faults in product(range(4), repeat=4):
            rows = list(zip(initials, faults, strict=True))
            names = [(i, ["", "blank", "duplicate", "truncated"][f]) for i, f in rows]
            ((got),) = repair.search(rows, repair.START, True).values()
            assert got == plain_audit(names)


def test_repair_against_plain_version(spark):
    r = random.Random(5)
    rows = some_turns(r, 60, 9) + [(900, t, r.choice(["user", "assistant"]), r.choice(["Ja.", "no", f"{t}!", ""])) for t in range(1500)]
    df = spark.createDataFrame([(*x, "c", "p", 1) for x in rows], TURNS)
    assert repaired(repair.repair_conversations(df)) == plain_repair(rows)


def test_pieces_put_together_like_whole_conversations():
    r = random.Random(8)
    for _ in range(300):
        rows = [(r.choice("suaax"), r.choice([0, 0, 0, 1, 2, 3]), "", "") for _ in range(r.randint(1, 14))]
        cuts = sorted(r.sample(range(len(rows) + 1), min(len(rows), r.randint(0, 4))))
        parts = [rows[i:j] for i, j in zip([0, *cuts], [*cuts, len(rows)])]
        pieces = []
        for k, p in enumerate(parts):
            piece = repair._Piece(1)
            for t, x in enumerate(p):
                piece.add(t, (x[0], x[1], {"s": "system", "u": "user", "a": "assistant"}.get(x[0], "x"), ""))
            pieces.append(piece.record(False, 0, k))
        got = repair._put_together(1, iter(pieces))
        assert ((got["cost"], got["audit"]),) == tuple(repair.search(rows, repair.START, True).values())
        assert "".join(s["audit"] for s in got["steps"]) == got["audit"]


def test_repair_odd_rows(spark):
    rows = [(None, None, None, None), (None, None, "user", "Hi."), (1, 3, "", "Empty role."), (2, None, "user", "A."), (2, 5, "assistant", "B."), (3, 1, "user", "x " * 200_000 + "."), (3, 2, "assistant", "Yes."), (4, 0, "user", "Gone.")]
    df = spark.createDataFrame([(*x, "c", "p", 0 if x[0] == 4 else 1) for x in rows], TURNS)
    got = repaired(repair.repair_conversations(df, F.col("extra")))
    want = plain_repair([r for r in rows if r[0] != 4])
    # the two null turns of the null conversation are in either order, for the same edits but theirs
    assert {k: v for k, v in got.items() if k not in (None, 4)} == {k: v for k, v in want.items() if k is not None}
    assert got[None][5] == want[None][5] and got[4] == (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())
    twice = repaired(repair.repair_conversations(df.filter("conv_id = 2").withColumn("extra", F.lit(3)), F.col("extra")))
    assert twice[2][6] == "KDDKDD" and twice[2][2] == 4
    assert repair.repair_conversations(df.limit(0)).count() == 0


def test_repaired_turns_are_what_the_digest_says(spark):
    rows = some_turns(random.Random(9), 20, 8)
    df = spark.createDataFrame([(*x, "c", "p", 1) for x in rows], TURNS)
    said = {}
    for t in sorted(repair.repaired_turns(df).collect(), key=lambda t: (t["conv_id"], t["part"], t["seq"], t["place"])):
        said.setdefault(t["conv_id"], []).append(f"{t['role']}:{t['text']}")
        assert t["role"] is not None
    for conv, v in repaired(repair.repair_conversations(df)).items():
        assert v[-1] == hashlib.sha256("\n".join(said.get(conv, [])).encode()).hexdigest()


def test_damage(spark):
    rows = [(c, t, "assistant", "A. b! c?") for c in range(30) for t in range(10)] + [(None, None, None, None), (7, None, None, None)]
    df = spark.createDataFrame([(*x, "c", "p", 1) for x in rows], TURNS)
    want = []
    for c, t, role, text in rows:
        kind = zlib.crc32(f"{' ' if c is None else c}:{' ' if t is None else t}".encode()) % 20
        text, role = " " if text is None else text, " " if role is None else role
        want.append((c, t, "user" if kind == 4 else role, "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text, {0: 0, 3: 2}.get(kind, 1)))
    assert sorted(map(tuple, repair.damaged(df).collect()), key=repr) == sorted(want, key=repr)


# license scans


def plain_words(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return [w for w in re.split(r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+", low) if w]


def plain_base(text):
    w = plain_words(text)
    places = [(i, label) for label, phrase in licenses.PHRASES for i in range(len(w)) if w[i : i + len(phrase.split())] == phrase.split()]
    at = [i for i, _ in places]
    return len(w), len(at), min(at, default=None), max(at, default=None), ",".join(sorted({x for _, x in places}))


MIT = next(t for label, t in licenses.NOTICES if label == "mit-text")


def test_license_scan(spark):
    edited = MIT.replace("to any person obtaining", "freely to each person obtaining").replace("sublicense, ", "")
    texts = [None, "", "no words: !", "Released under the MIT License.", "cc by CC-BY cc by", "İ cc by é CC BY-NC 4.0", "GNU General Public License", "gnu general public licenses", "the gnu\x00general_public license, version 3!", MIT, "Preface. " + edited + " End.",
             "of the software " * 3000, MIT[:150], ("apache license " * 2000), "Apache license", "word " * 300 + MIT + " word" * 300 + MIT, "K mit license"]
    docs = spark.createDataFrame([(i, t, "x", "y") for i, t in enumerate(texts)] + [(None, texts[3], "x", "y"), (3, texts[3], "x", "y")], "doc_id long, text string, labels string, gram string")
    rows = licenses.license_scan(docs).collect()
    assert len(rows) == len(texts) + 2
    for r in rows:
        text = texts[3] if r["doc_id"] is None else texts[r["doc_id"]]
        assert tuple(r[c] for c in ("n_words", "n_base", "first_word", "last_word", "base_labels")) == plain_base(text), text
        assert set(filter(None, r["base_labels"].split(","))) <= set(r["labels"].split(",")) and 0 <= r["score"] <= 1
    by = {r["doc_id"]: r for r in rows}
    assert by[5]["labels"] == "cc-by,cc-by-nc-4.0" and by[8]["labels"] == "gpl,gpl-3.0" and by[9]["labels"] == "mit-text" and by[9]["score"] == 1.0
    assert by[10]["labels"] == "mit-text" and MIN < by[10]["score"] < 1 and by[11]["labels"] == by[12]["labels"] == ""
    assert [s["first"] for s in by[15]["spans"]] == [300, 600 + len(plain_words(MIT))]
    assert licenses.license_scan(docs.limit(0)).count() == 0


MIN = licenses.MIN_SHARE


def test_license_scan_with_templates_too_large_to_broadcast(spark, monkeypatch):
    docs = spark.createDataFrame([(1, "a b c d e f"), (2, "a b x c d e f"), (3, "one two"), (4, "c d e")], "doc_id long, text string")
    own = spark.createDataFrame([(1, "all", "A B C D E F", False), (2, "two", "one two", True), (3, "none", "?!", True), (4, "three", "c d e", False)], licenses.TEMPLATES)
    want = [tuple(r) for r in licenses.license_scan(docs, own).orderBy("doc_id").collect()]
    assert [(r[1], r[2], r[6]) for r in want] == [(6, 0, "all,three"), (7, 0, "three"), (2, 1, "two"), (3, 0, "three")]
    monkeypatch.setattr(licenses, "broadcast_if_small", lambda df: df)
    assert [tuple(r) for r in licenses.license_scan(docs, own).orderBy("doc_id").collect()] == want
    assert {r["score"] for r in licenses.license_scan(docs, own.limit(0)).collect()} == {0.0}


# alignment


@pytest.fixture(scope="module")
def tokens():
    """text -> (ids, bytes) of both vocabularies, by the libraries that the files are for."""
    first = Tokenizer.from_file(alignment.BYTE_BPE)
    first.encode_special_tokens = True
    second = sentencepiece.SentencePieceProcessor(model_file=alignment.PIECE_BPE)
    printed = [*range(33, 127), *range(161, 173), *range(174, 256)]
    shown = {chr(b): b for b in printed} | {chr(256 + k): b for k, b in enumerate(x for x in range(256) if x not in printed)}

    def both(text):
        a = [(i, bytes(shown[c] for c in first.id_to_token(i))) for i in first.encode(" " + text, add_special_tokens=False).ids]
        b = [(i, bytes([int(second.id_to_piece(i)[3:5], 16)]) if second.is_byte(i) else second.id_to_piece(i).replace("▁", " ").encode()) for i in second.encode(text)]
        whole = (" " + text).encode()
        return (a, b) if b"".join(x[1] for x in a) == whole == b"".join(x[1] for x in b) else ([], [])

    return both


def placed(tokens):
    out, at = [], 0
    for i, piece in tokens:
        out.append((i, at, at + len(piece)))
        at += len(piece)
    return out


def plain_alignment(rows, tokens):
    out, linked = [], []
    for doc_id, text in rows:
        a, b = map(placed, tokens(text) if text else ([], []))
        low, groups = 0, []
        for cut in sorted({e for _, _, e in a} & {e for _, _, e in b}):
            groups.append("|".join(",".join(str(i) for i, _, e in side if low < e <= cut) for side in (a, b)))
            low = cut
        linked.append([(i, j) for i, p, e in a for j, q, f in b if p < f and q < e])
        out.append((doc_id, len(a), len(b), len(groups), len(linked[-1]), hashlib.sha256(";".join(groups).encode()).hexdigest() if a else ""))
    counts = Counter(p for x in linked for p in set(x))
    top = {}
    for (i, _), n in counts.items():
        top[i] = max(top.get(i, 0), n)
    return sorted(((*o[:5], sum(counts[p] == top[p[0]] for p in x), sum(counts[p] for p in x), o[5]) for o, x in zip(out, linked, strict=True)), key=repr)


ODD_TEXTS = ["Hello world! don't stop", None, "", "a▁b", "fine a▁b fine", "<|endoftext|> héllo 漢字 <s> \U0001f600", "  two  spaces\n\n\tx ", " ", "12345 \x00\x7f zero", "ﬁ ½ Å  nbsp   x", "word " * 30, "a\n b \t c　 d \x1c e", "x" * 3000, "trailing  ", "▁", "it's we'll 'S n't"]


def test_alignment_against_plain_version(spark, tokens):
    rows = list(enumerate(ODD_TEXTS)) + [(None, "Hello world!"), (0, "Hello world! don't stop"), (0, "Hello world! don't stop")]
    df = spark.createDataFrame([(*r, 1, "p") for r in rows], "doc_id long, text string, pair int, n string").repartition(3)
    got = alignment.alignment_report(df)
    assert sorted(map(tuple, got.collect()), key=repr) == plain_alignment(rows, tokens)
    assert alignment.alignment_report(df.limit(0)).count() == 0


def test_texts_are_tokenized_as_if_whole(tokens):
    r = random.Random(4)
    chars = [" ", " ", " ", "  ", "\n", "\t", " ", "　", "\x1c", "a", "the", "'s", "é", "漢", "1", "23", ".", "!?", "-", "<s>", "\U0001f600", "▁", "ing", " "]
    known = alignment.Pieces(alignment.byte_level(), alignment.piece_level())
    assert not known.second.whole
    texts = ["".join(r.choices(chars, k=r.randint(1, 25))) for _ in range(1500)]
    batch = alignment._slice(list(range(len(texts))), texts, known).to_pydict()
    for k, text in enumerate(texts):
        a, b = tokens(text)
        assert (batch["n_a"][k], batch["n_b"][k]) == (len(a), len(b)), text
        groups = plain_alignment([(0, text)], lambda _, x=(a, b): x)[0]
        assert (batch["n_groups"][k], batch["n_links"][k], batch["groups_sha256"][k]) == (groups[3], groups[4], groups[7]), text


def test_pieces_are_forgotten_and_a_shuffle_join_gives_the_same(spark, monkeypatch):
    rows = [(i, f"word{i % 7} and {'x' * (i % 5)} {i} more") for i in range(60)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    want = sorted(map(tuple, alignment.alignment_report(df).collect()))
    monkeypatch.setattr(alignment, "broadcast_if_small", lambda d: d)
    assert sorted(map(tuple, alignment.alignment_report(df).collect())) == want
    known = alignment.Pieces(alignment.byte_level(), alignment.piece_level())
    one = alignment._slice([i for i, _ in rows], [t for _, t in rows], known)
    monkeypatch.setattr(alignment, "MOST_PIECES", 0)
    assert alignment._slice([i for i, _ in rows], [t for _, t in rows], known) == one
