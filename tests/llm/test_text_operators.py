"""Decontamination, secrets, chat, BPE and language identification."""

import base64
import hashlib
import json
import random
import re

import numpy as np
import pyarrow as pa
import pytest

from concordat.llm import bpe, chat, common, decontaminate, langid, secrets
from concordat.llm.common import ALNUM_WORD, ASCII_LOWER, SPACED_WORD, byte_words, mix64, slice_hashes, text_groups

WORD2 = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
UPPER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def rows_of(df, *names):
    return [tuple(r[n] for n in names) for r in df.collect()]


# --- words -----------------------------------------------------------------------------------


def test_byte_words_match_regex():
    texts = ["", None, "A b", " x ", "é-É_z9", "a" * 3000, "q\tw\x0be\x1f!"] * 3
    for is_word, pattern in ((ALNUM_WORD, WORD2), (SPACED_WORD, re.compile(r"[^\x20\x09-\x0D]+"))):
        for a, b, data, offsets in text_groups(pa.array(texts), 50):
            starts, ends, h, first = byte_words(data, offsets, is_word, ASCII_LOWER)
            low = ASCII_LOWER[data].tobytes()
            for r in range(b - a):
                got = [low[s:e].decode() for s, e in zip(starts[first[r] : first[r + 1]], ends[first[r] : first[r + 1]])]
                assert got == pattern.findall((texts[a + r] or "").translate(UPPER))
            if len(h):
                assert len({x: y for x, y in zip(h.tolist(), (low[s:e] for s, e in zip(starts, ends)))}) == len(set(h.tolist()))


def regular_words(n):
    """Two words of n letters that a polynomial hash modulo 2^64 can't tell apart from n = 1024 on."""
    bits = [bin(k).count("1") % 2 for k in range(n)]
    return "".join("ac"[b] for b in bits), "".join("ca"[b] for b in bits)


def test_regular_words_differ():
    for k in range(10, 14):
        one, two = regular_words(1 << k)
        data = np.frombuffer(f"{one} {two}".encode(), np.uint8)
        _, _, h, _ = byte_words(data, np.array([0, len(data)]), SPACED_WORD)
        assert h[0] != h[1]


def test_slice_hashes_by_definition():
    rng = random.Random(4)
    data = np.frombuffer(bytes(rng.choices(range(256), k=3000)), np.uint8)
    cut = np.sort(rng.sample(range(3001), 400))
    starts, ends = cut[::2], cut[1::2]
    got = slice_hashes(data, starts, ends, ASCII_LOWER)
    for s, e, h in zip(starts.tolist(), ends.tolist(), got):
        value = sum((int(ASCII_LOWER[c]) + 1) * pow(common._POINT, k, common.PRIME) for k, c in enumerate(data[s:e])) % common.PRIME
        assert h == mix64(np.array([value], np.uint64) + np.array([e - s], np.uint64) * np.uint64(0xD6E8FEB86659FD93))[0]


def test_long_slices_are_hashed_too(monkeypatch):
    text = b"ab" * 500 + b" " + b"AB" * 500 + b" " + b"ab" * 499 + b"ac"
    monkeypatch.setattr(common, "_SPAN", 64)
    data = np.frombuffer(text, np.uint8)
    _, _, h, _ = byte_words(data, np.array([0, len(data)]), SPACED_WORD, ASCII_LOWER)
    assert h[0] == h[1] != h[2]


# --- decontamination -------------------------------------------------------------------------


def brute_contamination(text, items, window=13):
    words = WORD2.findall((text or "").translate(UPPER))
    hit, found = set(), set()
    for item, body in items:
        w = WORD2.findall((body or "").translate(UPPER))
        for k in range(max(1, len(w) - window + 1) if w else 0):
            piece = w[k : k + window]
            for p in range(len(words) - len(piece) + 1):
                if words[p : p + len(piece)] == piece:
                    hit.update(range(p, p + len(piece)))
                    found.add(str(item))
    return len(words), len(hit), sorted(found)


def decontamination_case():
    rng = random.Random(3)
    word = lambda: rng.choice("a b c d e f gg hh".split())
    items = [(k, " ".join(word() for _ in range(rng.choice((1, 3, 13, 14, 20, 40))))) for k in range(12)]
    items += [(99, None), (98, ""), (97, "-- !!"), (5, "Straße 12 B C")]
    texts = [" ".join(word() for _ in range(rng.randint(0, 400))) for _ in range(40)]
    texts += ["x " + items[4][1].upper() + ". y", None, "", items[3][1] * 2, " ".join(["a"] * 700), "z STRAßE, 12 b c!"]
    return items, texts


def test_fm_index_against_brute_force(spark):
    items, texts = decontamination_case()
    docs = spark.createDataFrame([(i, t, 7) for i, t in enumerate(texts)], "doc_id long, text string, n_hit int")
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = {r["doc_id"]: r for r in decontaminate.contamination(docs, bench).collect()}
    in_blocks = {r["doc_id"]: r for r in decontaminate.contamination(docs, bench, block_bytes=200).collect()}
    for i, t in enumerate(texts):
        n, hit, ids = brute_contamination(t, items)
        for r in (got[i], in_blocks[i]):
            assert (r["n_words"], r["n_hit"], r["item_ids"]) == (n, hit, ids), i
            assert r["contaminated"] == (hit > 0 and 20 * hit >= n)
        low = (t or "").encode()
        assert sum(len(WORD2.findall(low[s["start"] : s["end"]].decode().translate(UPPER))) for s in got[i]["spans"]) == hit


def test_regular_words_are_no_hits(spark):
    pairs = [regular_words(1 << k) for k in range(10, 14)]
    docs = spark.createDataFrame([(i, f"{one} x") for i, (one, _) in enumerate(pairs)], "doc_id long, text string")
    for at, hits in ((1, [0] * 4), (0, [1] * 4)):
        items = spark.createDataFrame([(i, p[at]) for i, p in enumerate(pairs)], "item_id long, text string")
        assert [r["n_hit"] for r in decontaminate.contamination(docs, items).orderBy("doc_id").collect()] == hits


def test_one_text_in_many_items_goes_in_blocks(spark):
    items = spark.createDataFrame([(i, "one two three") for i in range(300)] + [(7, "one two three")] * 50 + [(500, "four five")], "item_id long, text string")
    docs = spark.createDataFrame([(0, "zero one two three"), (1, "four five six"), (2, None)], "doc_id long, text string")
    got = {r["doc_id"]: r for r in decontaminate.contamination(docs, items, block_bytes=400).collect()}
    assert got[0]["item_ids"] == sorted(map(str, range(300))) and got[1]["item_ids"] == ["500"] and got[2]["item_ids"] == []


def test_suffix_array_and_ranks():
    rng = np.random.default_rng(1)
    text = rng.integers(0, 4, 300)
    text[-1] = 0
    text[100:150] = 2
    sa = decontaminate.suffix_array(text)
    zeros = (text == 0).sum()
    key = np.where(text == 0, np.cumsum(text == 0) - 1, text + zeros).tolist()
    assert sa.tolist() == sorted(range(300), key=lambda i: key[i:])


def test_decontamination_odd_rows(odd_docs, no_docs, spark):
    bench = spark.createDataFrame([(1, "one two three"), (None, "solo")], "item_id long, text string")
    got = decontaminate.contamination(odd_docs, bench)
    assert got.count() == odd_docs.count()
    by = {(r["doc_id"], r["text"]): r for r in got.collect()}
    assert by[(10, "One TWO three")]["item_ids"] == ["1"] and by[(11, "solo")]["contaminated"] and by[(11, "solo")]["n_items"] == 0
    assert not by[(6, None)]["contaminated"] and by[(6, None)]["n_words"] == 0
    assert decontaminate.contamination(no_docs, bench).count() == 0
    none = decontaminate.contamination(odd_docs, bench.limit(0)).collect()
    assert not any(r["contaminated"] for r in none) and len(none) == odd_docs.count()


# --- secrets ---------------------------------------------------------------------------------


def der(tag, *parts):
    body = b"".join(parts)
    n = len(body)
    size = bytes([n]) if n < 128 else bytes([0x80 | len(x := n.to_bytes((n.bit_length() + 7) // 8, "big"))]) + x
    return bytes([tag]) + size + body


def fake_keys():
    rng = random.Random(5)
    big = lambda n: der(2, b"\x01" + rng.randbytes(n))
    rsa = der(0x30, der(2, b"\0"), *[big(60) for _ in range(8)])
    pkcs8 = der(0x30, der(2, b"\0"), der(0x30, der(6, b"\x2a\x86\x48\x86"), der(5)), der(4, rsa))
    ec = der(0x30, der(2, b"\1"), der(4, rng.randbytes(32)), der(0xA0, der(6, b"\x2a\x86\x48")))
    field = lambda x: len(x).to_bytes(4, "big") + x
    ssh = b"openssh-key-v1\0" + field(b"none") + field(b"none") + field(b"") + (1).to_bytes(4, "big") + field(rng.randbytes(51)) + field(rng.randbytes(140))
    return rsa, pkcs8, ec, ssh


def test_structure():
    for raw in fake_keys():
        for text in (base64.b64encode(raw).decode(), base64.urlsafe_b64encode(raw).decode().rstrip("="), raw.hex(), raw.hex().upper()):
            assert secrets.is_key(text)
        assert not secrets.is_key(base64.b64encode(raw[:-1]).decode())
        assert not secrets.is_key(base64.b64encode(raw + b"\1").decode())
    assert not secrets.is_key(base64.b64encode(random.Random(1).randbytes(600)).decode())


def brute_secrets(text):
    letters = lambda word: "".join(f"[{c.lower()}{c.upper()}]" if c.isalpha() else c for c in word)
    names = "|".join([*map(letters, ("password", "passwd", "secret", "token")), letters("api") + "_?" + letters("key")])
    assign = f"({names})[\"']?\\x20*[:=]\\x20*[\"']?([A-Za-z0-9+/_.=-]+)"
    out = [("assign", m.start(), m.end()) for m in re.finditer(assign, text) if len(m[2]) >= 6]
    out += [("access", m.start(), m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    out += [("hex", m.start(), m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 24]
    return sorted(out, key=lambda x: (x[1], secrets.KINDS.index(x[0])))


def test_secret_spans(spark):
    part = lambda x: base64.urlsafe_b64encode(json.dumps(x).encode()).decode().rstrip("=")
    token = part({"alg": "HS256", "typ": "JWT"}) + "." + part({"sub": 1}) + "." + "c2lnbmF0dXJlLXNpZ25hdHVyZQ"
    no_token = part({"typ": "JWT", "x": "abcdefgh"}) + "." + part({"sub": 1}) + ".c2lnbmF0dXJlLXNpZ25hdHVyZQ"
    rsa, pkcs8, ec, ssh = (base64.b64encode(k).decode() for k in fake_keys())
    pem = "-----BEGIN PRIVATE KEY-----\n" + "\n".join(pkcs8[k : k + 64] for k in range(0, len(pkcs8), 64)) + "\n-----END PRIVATE KEY-----"
    texts = ["é password = hunter22x", "PassWord:'abc'", f"é日 {token} end", no_token, f"key {ec}.", f"secret={ssh}", f"日本 {pem} tail", "AKIA" + "A" * 16, "AKIA" + "A" * 15, "ab12" * 6, "ab12" * 5 + "abc", "toKen token=abcdef passwd: x", "ſecret=abcdefgh", None, "", "api_key\": \"0123456789abcdef01234567", rsa[:-4]]
    docs = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "doc_id long, text string, secrets string")
    got = {r["doc_id"]: [(s["kind"], s["start"], s["end"]) for s in r["secrets"]] for r in secrets.scan(docs).collect()}
    for i, t in enumerate(texts):
        assert [s for s in got[i] if s[0] in ("assign", "access", "hex")] == brute_secrets(t or ""), i
    extra = {i: [(s[0], texts[i][s[1] : s[2]]) for s in got[i] if s[0] in ("token", "key", "pem")] for i in got}
    assert extra[2] == [("token", token)] and extra[3] == [] and extra[4] == [("key", ec)] and extra[5] == [("key", ssh)] and extra[6] == [("pem", pem)] and extra[16] == []
    clean = {r["doc_id"]: r["text"] for r in secrets.redact(secrets.scan(docs)).collect()}
    assert clean[0] == "é [REDACTED]" and clean[5] == "[REDACTED]" and clean[6] == "日本 [REDACTED] tail" and clean[13] is None and clean[1] == texts[1]


def test_keys_in_other_places(spark):
    keys = [base64.b64encode(k).decode() for k in fake_keys()]
    rows, wanted = [], []
    for key in keys:
        lines = [key[k : k + 64] for k in range(0, len(key), 64)]
        for before, body, after in (("/etc/keys/", key, ""), ("see\n", "\n".join(lines), "\nmore words"), ("x ", "\r\n".join(lines), " .\n"), ('"', "\\n".join(lines), '"')):
            rows.append((len(rows), before + body + after))
            wanted.append(body)
    n = len(rows)
    escaped = "-----BEGIN RSA PRIVATE KEY-----\\n" + "\\n".join(keys[0][k : k + 64] for k in range(0, len(keys[0]), 64)) + "\\n-----END RSA PRIVATE KEY-----"
    deep = b""
    for _ in range(secrets.DEPTH + 4):
        deep = der(0x30, deep)
    too_deep = base64.b64encode(der(0x30, der(2, b"\0"), der(0x30, der(6, b"\x2a\x86\x48\x86"), deep), der(4, b"x" * 40))).decode()
    rows += [(n, escaped), (n + 1, too_deep), (n + 2, keys[0] + "AAAA"), (n + 3, "/M" * 20_000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["doc_id"]: [(s["kind"], r["text"][s["start"] : s["end"]]) for s in r["secrets"] if s["kind"] in ("token", "key", "pem")] for r in secrets.scan(docs).collect()}
    assert [got[i] for i in range(n)] == [[("key", w)] for w in wanted]
    assert got[n] == [("pem", escaped)] and not got[n + 1] and not got[n + 2] and not got[n + 3]


def test_secrets_odd_rows(odd_docs, no_docs):
    assert secrets.scan(odd_docs).count() == odd_docs.count()
    assert secrets.scan(no_docs).count() == 0


# --- chat ------------------------------------------------------------------------------------


def test_escapes_round_trip():
    rng = random.Random(2)
    bits = ["<", "s>", "/", "\\", "n", "\n", "[INST]", "</s>", "<|im_end|>", "<s", "|", "assistant", "<<SYS>>", "é"]
    for _ in range(2000):
        turns = [("".join(rng.choices(bits, k=rng.randint(0, 6))), "".join(rng.choices(bits, k=rng.randint(0, 9)))) for _ in range(3)]
        out, spans = chat.turn_spans(chat.marked_turns, turns)
        assert chat.read_back(out) == turns
        assert [chat.unescape(out[c:d]) for _, _, c, d in spans] == [t for _, t in turns]
        assert not any(c in chat.escape(t) for _, t in turns for c in chat.CONTROLS)


def test_rewriting_template_is_detected(spark):
    counted = lambda turns: f"{len(turns)} turns:" + chat.marked_turns(turns)
    with pytest.raises(chat.RewritesHistory):
        chat.turn_spans(counted, [("user", "a"), ("assistant", "b")])
    rows = spark.createDataFrame([(1, 0, "user", "a"), (1, 1, "assistant", "b")], "conv_id long, turn long, role string, text string")
    assert [r["rewritten"] for r in chat.pieces(rows, counted).collect()] == [True] * chat.pieces(rows, counted).count()


def test_long_odd_conversations(spark):
    rng = random.Random(4)
    rows = [(1, k, rng.choice(("user", "assistant")), f"t{k} </s>" * rng.randint(0, 3)) for k in range(chat.PIECE * 5 + 3)]
    rows += [(2, None, None, None), (2, 1, "assistant", ""), (2, 1, "assistant", ""), (None, 0, "user", "x"), (3, 2, "system\nx", "a\\nb")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(3)
    got = {r["conv_id"]: r for r in chat.summaries(chat.pieces(df.withColumn("part", df["turn"]))).collect()}
    for conv in {r[0] for r in rows}:
        turns = sorted([(-1 if t is None else t, r or "", x or "") for c, t, r, x in rows if c == conv])
        body = "".join(f"{r}\n{x}\n" for _, r, x in turns)
        loss = "".join(x for _, r, x in turns if r == "assistant")
        whole = chat.marked_turns([(r, x) for _, r, x in turns])
        want = (len(turns), hashlib.sha256(body.encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest(), len(whole))
        assert tuple(got[conv])[1:] == want
    assert chat.summaries(chat.pieces(df.limit(0))).count() == 0


@pytest.mark.parametrize("partitions", [1, 7])
def test_conversations_are_rendered_as_wholes(spark, partitions):
    headed = lambda turns: ("<bos>[system]\n" if turns else "") + chat.marked_turns(turns)
    numbered = lambda turns: "".join(f"{k}. {r}: {t}\n" for k, (r, t) in enumerate(turns))
    forgetful = lambda turns: chat.marked_turns(turns[-40:])
    long = [(k, "user" if k % 2 == 0 else "assistant", f"turn {k}") for k in range(100)]
    rows = [(c, *t) for c in (5, None) for t in long] + [(c, *t) for c in (1, 9) for t in long[:40]] + [(2, *long[0])]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(3)
    spark.conf.set("spark.sql.shuffle.partitions", partitions)
    try:
        got = {}
        for template in (headed, numbered, forgetful):
            for r in chat.pieces(df, template).orderBy("part", "piece").collect():
                got.setdefault((template, r["conv_id"]), []).append(r)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", 4)
    for (template, conv), found in got.items():
        turns = [(r, t) for c, _, r, t in rows if c == conv]
        assert "".join(r["formatted"] for r in found) == template(turns), (template, conv)
        assert {r["rewritten"] for r in found} == {template is forgetful and len(turns) > 40}
        if template is not forgetful or len(turns) <= 40:
            texts = [r["formatted"][a:b] for r in found for a, b in zip(r["text_starts"], r["text_ends"])]
            assert texts == [t for _, t in turns]
    assert len(got) == 15


# --- byte-level BPE --------------------------------------------------------------------------


@pytest.fixture(scope="module")
def tiktoken_encoding():
    import public_tokenizers
    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(bpe.default_path(), "rb"))}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_bpe_matches_library(tiktoken_encoding):
    rng = random.Random(1)
    signs = "ab'strevmlld  \n\t 　é漢字12½.,!?'' 😀ǅـ\x1c\x85"
    texts = ["", " ", " 's", "don't we'll I'VE ''s 'tis  x\n\n y \n", "x" * 500, "= " * 300, "ab" * 3000, "é" * 200]
    texts += ["".join(rng.choice(signs) for _ in range(rng.randint(0, 40))) for _ in range(1500)]
    c = bpe.Coder(bpe.default_path())
    for a, b, data, offsets in text_groups(pa.array(texts), 4000):
        ids, first, stop = c.encode_group(data, offsets)
        for r in range(a, b):
            assert ids[first[r - a] : first[r - a + 1]].tolist() == tiktoken_encoding.encode_ordinary(texts[r]), texts[r]
        assert c.decode_group(ids) == data.tobytes() and (not len(stop) or stop[-1] == len(data))


def test_bpe_of_regular_and_long_texts(spark, tiktoken_encoding, monkeypatch):
    rng = random.Random(2)
    texts = [" ".join(regular_words(1 << k)) for k in range(10, 14)]
    texts += ["".join(rng.choices("abc 'tsrevel  \n\n\t0129é漢!?.'", k=rng.randint(100, 900))) for _ in range(150)]
    texts += ["a" * 700, " " * 700, "\n\n" * 300 + "b", "'re" * 200, "x  " * 300]
    c = bpe.Coder(bpe.default_path())
    for text in texts:
        data = np.frombuffer(text.encode(), np.uint8)
        ids, _, _ = c.encode_group(data, np.array([0, len(data)]))
        assert ids.tolist() == tiktoken_encoding.encode_ordinary(text) and c.decode_group(ids) == text.encode()
    monkeypatch.setattr(bpe, "PART_BYTES", 64)
    for text in texts:
        data = np.frombuffer(text.encode(), np.uint8)
        parts = list(c.encode_long(data))
        assert [i for ids, _, _ in parts for i in ids.tolist()] == tiktoken_encoding.encode_ordinary(text)
        row = bpe.long_digests(c, pa.array([1]), data).to_pylist()[0]
        want = tiktoken_encoding.encode_ordinary(text)
        assert row == {"doc_id": 1, "n_tokens": len(want), "ids_sha256": hashlib.sha256(" ".join(map(str, want)).encode()).hexdigest(), "decoded_sha256": hashlib.sha256(text.encode()).hexdigest()}
    assert len(parts) > 3


def test_bpe_false_matches_go_by_content(monkeypatch, tiktoken_encoding):
    monkeypatch.setattr(bpe, "slice_hashes", lambda data, starts, ends: (ends - starts).astype(np.uint64))
    text = "one two six ten one two 12 34 do so"
    data = np.frombuffer(text.encode(), np.uint8)
    ids, _, _ = bpe.Coder(bpe.default_path()).encode_group(data, np.array([0, len(data)]))
    assert ids.tolist() == tiktoken_encoding.encode_ordinary(text)


def test_bpe_long_text_and_clashing_columns(spark, tiktoken_encoding):
    long = "the quick brown fox don't jump\n" * 80_000
    df = spark.createDataFrame([(1, long, [1], "y"), (2, "ab", None, "z")], "doc_id long, text string, ids array<int>, id_ends string")
    rows = {r["doc_id"]: r for r in bpe.encode(df).collect()}
    want = tiktoken_encoding.encode_ordinary(long)
    assert rows[1]["ids"] == want and rows[1]["id_ends"][-1] == len(long) and len(rows[2]["ids"]) == 1
    got = bpe.digests(df).where("doc_id = 1").first()
    assert got["n_tokens"] == len(want) and got["decoded_sha256"] == hashlib.sha256(long.encode()).hexdigest()


def test_bpe_columns_and_digests(odd_docs, no_docs, tiktoken_encoding):
    out = bpe.decode(bpe.encode(odd_docs))
    for r in out.collect():
        text = r["text"] or ""
        assert r["ids"] == tiktoken_encoding.encode_ordinary(text) and bytes(r["decoded"]) == text.encode()
        assert [text.encode()[a:b] for a, b in zip([0, *r["id_ends"]], r["id_ends"])] == [tiktoken_encoding.decode_single_token_bytes(i) for i in r["ids"]]
    for doc, n, ids, text in rows_of(bpe.digests(odd_docs).where("doc_id = 14"), "doc_id", "n_tokens", "ids_sha256", "decoded_sha256"):
        want = tiktoken_encoding.encode_ordinary("é漢字 don't 's  \n\n end ")
        assert (n, ids) == (len(want), hashlib.sha256(" ".join(map(str, want)).encode()).hexdigest())
        assert text == hashlib.sha256("é漢字 don't 's  \n\n end ".encode()).hexdigest()
    assert bpe.digests(odd_docs).count() == odd_docs.count() and bpe.digests(no_docs).count() == 0


# --- language identification -----------------------------------------------------------------


def brute_phrases(text, sample):
    count, i = 0, 0
    while i < len(text):
        n = 1
        while i + n < len(text) and text[i : i + n + 1] in sample:
            n += 1
        count, i = count + 1, i + n
    return count


def test_automaton_parses_like_longest_match():
    rng = np.random.default_rng(2)
    sample, width = rng.integers(1, 5, 400).tolist(), 8
    parse = langid.automaton(sample, width)
    joined = "".join(map(str, sample))
    for _ in range(30):
        text = rng.integers(1, 6, 60).tolist()
        state, phrases = 0, 1
        for c in text:
            got = int(parse[state + c])
            phrases, state = phrases + (got & 1), got >> 1
        # a symbol that the sample lacks is a phrase of its own in either
        want = brute_phrases("".join(map(str, text)), joined)
        assert abs(phrases - want) <= text.count(5) + 1


def left_to_right(m, text):
    """Phrases per language of a parse from left to right, by substring tests on the samples' symbols."""
    raw = np.frombuffer(text.encode(), np.uint8)
    code, _ = langid.symbols_of(raw, np.array([0, len(raw)]), m.table)
    out = []
    for root, owner, to, restart in m.parse:
        state, phrases = root, 1
        for c in code.tolist():
            if owner[state + c] != state:
                state, phrases = int(restart[c]), phrases + 1
            else:
                state = int(to[state + c])
        out.append(phrases)
    return len(code), out


@pytest.mark.parametrize("few", [0, 32])
def test_language_predictions_against_brute_force(spark, sf, monkeypatch, few):
    monkeypatch.setattr(langid, "FEW", few)
    docs = spark.read.parquet(f"{sf}/documents.parquet").limit(60)
    samples = langid.training_samples(docs)
    m = langid.Model(samples)
    texts = [r["text"] or "" for r in docs.collect()] + ["a" * 3000, "ab" * 1500, "the " * 900, "", "12", "é" * 700]
    for a, b, data, offsets in text_groups(pa.array(texts), 60_000):
        names, scores = m.predict(data, offsets)
        for text, name, score in zip(texts[a:b], names, scores):
            size, counts = left_to_right(m, text)
            if not any(ch.isalpha() for ch in text):
                assert (name, score) == ("und", 0)
                continue
            each = [n * w / size for n, w in zip(counts, m.weight)]
            assert name == m.names[min(range(len(each)), key=each.__getitem__)]
            assert abs(score - (1 - min(each) / sorted(each)[1])) < 1e-12


def test_language_clashing_columns_and_long_text(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    samples = langid.training_samples(docs)
    df = spark.createDataFrame([(1, "the and that of which " * 100_000, "x", 2), (2, None, "y", 3)], "doc_id long, text string, score string, lang_pred int")
    got = {r["doc_id"]: r for r in langid.identify(df, samples).collect()}
    assert got[2]["lang_pred"] == "und" and got[1]["lang_pred"] in {n for n, _ in samples} and 0 <= got[1]["score"] <= 1


def test_language_accuracy_on_held_out(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    got = langid.query(spark, sf).join(docs.select("doc_id", "lang"), "doc_id").where("held_out and lang is not null").collect()
    assert len(got) > 10 and sum(r["lang"] == r["lang_pred"] for r in got) / len(got) >= 0.95
    assert all(0 <= r["score"] <= 1 for r in got)


def test_language_odd_rows(odd_docs, no_docs):
    samples = langid.training_samples(odd_docs)
    got = {(r["doc_id"], r["text"]): r for r in langid.identify(odd_docs, samples).collect()}
    assert {r["lang_pred"] for r in got.values()} == {"en", "und"} and got[(6, None)]["lang_pred"] == got[(7, "")]["lang_pred"] == got[(15, "😀" * 50)]["lang_pred"] == "und"
    assert {r["lang_pred"] for r in langid.identify(odd_docs, langid.training_samples(no_docs)).collect()} == {"und"}
    assert langid.identify(no_docs, samples).count() == 0


def script_samples():
    """Texts over wide alphabets with repeated words: (language, text)."""
    rng = random.Random(11)
    ranges = {"zh-x": (0x4E00, 3000), "zh-y": (0x4E00, 3000), "ja": (0x3041, 80), "ko": (0xAC00, 2000), "ru": (0x430, 32), "el": (0x3B1, 24), "ar": (0x627, 20), "en": (0x61, 26)}
    out = []
    for lang, (start, n) in ranges.items():
        words = ["".join(chr(start + rng.randrange(n)) for _ in range(rng.randint(2, 5))) for _ in range(600)]
        out += [(lang, " ".join(rng.choices(words, k=150))) for _ in range(70)]
    return out


def test_languages_of_many_scripts(spark):
    texts = script_samples()
    docs = spark.createDataFrame([(i, t, lang) for i, (lang, t) in enumerate(texts)], "doc_id long, text string, lang string")
    got = langid.identify(docs, langid.training_samples(docs.where("doc_id % 5 <> 0"))).where("doc_id % 5 = 0").collect()
    assert len(got) == 112 and [r["doc_id"] for r in got if r["lang"] != r["lang_pred"]] == []
    assert min(r["score"] for r in got) > 0.2


def test_every_letter_and_language_counts(spark):
    m = langid.Model((("el", "ΣΑΣ σας Κ" * 40), ("zh", "".join(chr(0x4E00 + k) for k in range(2000)))))
    assert len(set(m.table[0x4E00 : 0x4E00 + 2000].tolist())) == 2000 and m.table[ord("Σ")] == m.table[ord("σ")] != m.table[ord("ς")]
    docs = spark.createDataFrame([(k, chr(0x4E00 + k) * 50, f"l{k:03}") for k in range(100)], "doc_id long, text string, lang string")
    assert all(r["lang"] == r["lang_pred"] for r in langid.identify(docs, langid.training_samples(docs)).collect())


def test_packed_edges_are_those_of_the_automaton():
    rng = np.random.default_rng(3)
    for width in (8, 300):
        rows = langid.transitions(rng.integers(2, width, 4000).tolist())
        root, owner, to, restart = langid.packed(rows, width)
        base, todo = {0: root}, [0]
        while todo:
            state = todo.pop()
            found = {c: to[base[state] + c] for c in range(width) if owner[base[state] + c] == base[state]}
            assert found.keys() == rows[state].keys()
            for c, q in rows[state].items():
                if q not in base:
                    todo.append(q)
                assert base.setdefault(q, found[c]) == found[c]
        assert len(set(base.values())) == len(rows)
        assert [restart[c] for c in range(width)] == [base[rows[0].get(c, 0)] for c in range(width)]
