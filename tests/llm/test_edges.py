"""Nulls, empty and long texts, ties, repeated rows, empty tables and clashing columns, for every operator and stage."""

import base64
import hashlib
import json
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from quizweave.llm import chat, components, decontaminate, lines, lm, mixing, near_dups, secrets, token_files, topk, toxicity
from quizweave.llm.common import alnum_words, fold_of, spaced_words

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
LONG = "wort " * 200_000


def docs_of(spark, rows):
    return spark.createDataFrame([(i, t, "en", s, None if t is None else len(t)) for i, t, s in rows], DOCS)


@pytest.fixture(scope="module")
def odd(spark):
    """Null id, text and source; empty, blank and very long texts; repeated rows. More columns with names that operators use."""
    rows = [(1, None, "a"), (2, "", "a"), (3, " \n\t ", None), (4, LONG, "b"), (5, "one two three four", "a"), (5, "one two three four", "a"), (None, "one two three four", None), (6, "Ünï çode ß", "b")]
    df = docs_of(spark, rows)
    for name in ("__toxicity_score", "__overlap_spans", "mix_key", "row_key", "once", "kept_id", "component", "kept", "hash", "key", "lines", "score", "block", "copies", "node", "n_words", "count", "signature", "ids"):
        df = df.withColumn(name, F.lit("x"))
    return df


@pytest.fixture(scope="module")
def none(odd):
    return odd.where("false")


def test_words():
    text = "".join(map(chr, range(0x250))) + " Aa\x0bBb\x1cCc_Dd x"
    low = re.sub("[A-Z]", lambda m: m[0].lower(), text)
    assert [w.decode() for w in spaced_words(text.encode())] == re.findall(r"[^\x20\x09-\x0D]+", low)
    assert [w.decode() for w in alnum_words(text.encode())] == re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)


def test_fold(spark):
    got = {r.id: r.f for r in spark.range(50).withColumn("f", fold_of("id", 7)).collect()}
    assert got == {i: zlib.crc32(str(i).encode()) % 7 for i in range(50)}


# secrets


def der(tag, body):
    n = len(body)
    size = bytes([n]) if n < 128 else bytes([0x80 | (n.bit_length() + 7) // 8]) + n.to_bytes((n.bit_length() + 7) // 8, "big")
    return bytes([tag]) + size + body


PKCS1 = der(0x30, b"".join(der(2, bytes([i + 1]) * 12) for i in range(9)))
PKCS8 = der(0x30, der(2, b"\0") + der(0x30, der(6, b"\x2a\x86\x48") + der(5, b"")) + der(4, PKCS1))


def test_secret_kinds():
    b64 = lambda b: base64.b64encode(b).decode()
    url = lambda o: base64.urlsafe_b64encode(json.dumps(o).encode()).decode().rstrip("=")
    token = f"{url({'alg': 'HS256'})}.{url({'sub': 1})}.abc"
    pem = "-----BEGIN RSA PRIVATE KEY-----\n" + "\n".join(re.findall(".{1,64}", b64(PKCS1))) + "\n-----END RSA PRIVATE KEY-----"
    for text, kind in ((b64(PKCS8), "key_base64"), (PKCS1.hex().upper(), "key_hex"), (token, "token"), (pem, "key_pem")):
        assert [k for *_, k in secrets.confirmed_spans(f"é {text} x")] == [kind], kind
    broken = bytearray(PKCS8)
    broken[3] ^= 1
    for text in (b64(bytes(broken)), token.replace(token[:8], "eyJhbGci" + "x"), b64(b"x" * 60), pem.replace("-----END", "----END"), "A" * 44):
        assert not secrets.confirmed_spans(text)


def test_secret_keys_after_names_wrapped_and_packed():
    b64 = lambda b: base64.b64encode(b).decode()
    wrap = lambda t, n=64, end="\n": end.join(re.findall(f".{{1,{n}}}", t))
    rng = random.Random(5)
    dsa = der(0x30, der(2, b"\0") + b"".join(der(2, b"\1" + rng.randbytes(n)) for n in (128, 20, 127, 127, 19)))
    field = lambda b: len(b).to_bytes(4, "big") + b
    ssh = b"openssh-key-v1\0" + field(b"none") * 2 + field(b"") + (1).to_bytes(4, "big") + field(rng.randbytes(51)) + field(rng.randbytes(136))
    ed = der(0x30, der(2, b"\0") + der(0x30, der(6, b"\x2b\x65\x70")) + der(4, der(4, rng.randbytes(32))))
    pem = lambda label, body: f"-----BEGIN {label}-----\n{body}\n-----END {label}-----\n"
    assert b64(ed).startswith("MC4CAQAw")
    for key in (PKCS1, PKCS8, dsa, ssh, ed):
        for shown in (b64(key), b64(key).rstrip("="), base64.urlsafe_b64encode(key).decode()):
            for before in ("", "KEY=", "https://x.y/?a=1&k=", "private_key=", 'x="', "a/", "-", "_", "+", "k%3D", "a\\n"):
                text = f"é {before}{shown} x"
                assert secrets.confirmed_spans(text) == [(2 + len(before), len(text) - 2, "key_base64")], text
        for n in (64, 76):
            for end in ("\n", "\r\n", "\n  ", "\\n", " "):
                for text, kind in ((wrap(b64(key), n, end), "key_base64"), (wrap(key.hex(), n, end), "key_hex")):
                    assert secrets.confirmed_spans(f"NAME={text}\nrest of it") == [(5, 5 + len(text), kind)], text
        for label in ("PRIVATE KEY", "DSA PRIVATE KEY"):
            block = pem(label, wrap(b64(key)))
            assert [k for *_, k in secrets.confirmed_spans(f"NAME={block}")] == ["key_pem"] + ["key_base64"] * (key is ed)  # of one line
            for before in ("", "\n", "a\n", "a cert before\n"):
                for packed in (b64((before + block).encode()), wrap(b64((before + block).encode()), 76)):
                    ((a, b, kind),) = secrets.confirmed_spans(f"NAME={packed} x")
                    assert kind == "key_base64" and (before or a == 5) and 5 + len(packed) - 6 <= b <= 5 + len(packed), packed
        broken = key[:1] + bytes([key[1] ^ 1]) + key[2:]
        for bad in (b64(broken), b64(key)[:-8], b64(key) + "AAAA", wrap(b64(key)[:-8]) + "\nand prose goes on after it"):
            assert key is ssh or not secrets.confirmed_spans(f"NAME={bad}"), bad
    for text in ("\n", "\\n"):
        sealed = pem("RSA PRIVATE KEY", "Proc-Type: 4,ENCRYPTED\nDEK-Info: AES-128-CBC,0123456789ABCDEF0123456789ABCDEF\n\n" + wrap(b64(rng.randbytes(608)))).replace("\n", text)
        assert [k for *_, k in secrets.confirmed_spans(f"NAME={sealed}")] == ["key_pem"]
    assert not secrets.confirmed_spans(pem("RSA PRIVATE KEY", wrap(b64(rng.randbytes(608)))))


def slow_base(text):
    """One look at each place, as the contract words it."""
    out = []
    for kind, pattern in (("assign", secrets.ASSIGN), ("access", secrets.ACCESS), ("hex", re.compile("[0-9a-f]+"))):
        at = 0
        while at <= len(text):
            m = next((m for i in range(at, len(text)) if (m := pattern.match(text, i))), None)
            if not m:
                break
            if (kind == "assign" and len(m[2]) >= 6) or (kind == "access" and len(m[0]) >= 20) or (kind == "hex" and len(m[0]) >= 24):
                out.append((*m.span(), kind))
            at = m.end()
    return sorted(out)


def test_secret_base():
    rng = random.Random(3)
    parts = ["password", "Token", "secret=", "api_key", "APIKEY", ":", "=", " ", '"', "AKIA", "A1B2C3D4E5F6G7H8", "deadbeef" * 3, "x", "é", "ſecret", "abc123", "abcdef0123456789abcdef01", "_", "\n"]
    for _ in range(200):
        text = "".join(rng.choice(parts) for _ in range(12))
        assert sorted(secrets.base_spans(text)) == slow_base(text), text


@pytest.mark.parametrize("part", ["b3BlbnNzaC1rZXktdjEA", "6f70656e73" * 4 + "\n", "MIIE" + "A" * 12 + "\n", "MP8A/wIB", "/MIIEowIBAAKCAQEA", "-----BEGIN PRIVATE KEY-----\nMIIE", "LS0tLS1CRUdJTi", "eyJhIjoxfQ.", "secret  "])
def test_secrets_in_linear_time(part):
    """10 MB of what looks like the beginning of a key; a search that read on from each would take hours."""
    import time

    text = part * (10_000_000 // len(part))
    start = time.time()
    assert not secrets.confirmed_spans(text)
    secrets.base_spans(text)
    assert time.time() - start < 60


def test_secrets_query_finds_what_was_planted(spark, tmp_path):
    """Spans by construction: keys between words, with their places."""
    rng = random.Random(8)
    b64 = lambda b: base64.b64encode(b).decode()
    url = lambda o: base64.urlsafe_b64encode(json.dumps(o).encode()).decode().rstrip("=")
    lettered = der(0x30, b"".join(der(2, bytes([0x6A + i]) * 12) for i in range(6)) + b"".join(der(2, bytes([0x7A + i]) * 12) for i in range(4)))  # no long run of digits
    kinds = {
        "key_base64": lambda: b64(PKCS8), "key_hex": lambda: lettered.hex().upper(), "token": lambda: f"{url({'alg': 'none'})}.{url({'n': rng.randrange(99)})}.sig",
        "key_pem": lambda: "-----BEGIN PRIVATE KEY-----\n" + "\n".join(re.findall(".{1,64}", b64(PKCS8))) + "\n-----END PRIVATE KEY-----", "access": lambda: "AKIA" + "Q7" * 8, "hex": lambda: "0af3" * 8, "assign": lambda: 'api_key = "zzzzzz',
    }
    rows, want = [], {}
    for i in range(60):
        text, spans = "", []
        for _ in range(rng.randrange(5)):
            text += " ".join(rng.choices(["wort", "ñandú", "MIIE", "A" * 30, "b3Blbg"], k=rng.randrange(1, 6))) + " "
            kind = rng.choice(list(kinds))
            planted = kinds[kind]()
            spans.append((len(text), secrets.ORDER[kind], len(text) + len(planted), kind))
            text += planted + "' "
        rows.append((i, text))
        want[i] = (",".join(f"{k}:{a}:{b}" for a, _, b, k in sorted(spans)), sum(s[3] not in secrets.KINDS[:3] for s in spans))
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    assert {r.doc_id: (r.spans, r.n_confirmed) for r in secrets.op1_secret_scan(spark, str(tmp_path)).collect()} == want


def test_secrets_table(spark, odd, none):
    got = secrets.scan_secrets(odd)
    assert got.count() == odd.count() and secrets.scan_secrets(none).count() == 0
    assert {len(r.found) for r in got.collect()} == {0}


# decontamination


def test_overlap_edges(spark, odd, none):
    schema = "item_id long, text string"
    bench = spark.createDataFrame([(1, "two THREE"), (2, None), (3, ""), (None, "one"), (1, "two three"), (4, "Ünï çode")], schema)
    got = decontaminate.annotate_overlaps(odd, bench)
    seen = {(r.doc_id, r[decontaminate.N_WORDS], tuple(map(tuple, r[decontaminate.SPANS])), tuple(r[decontaminate.ITEMS])) for r in got.collect()}
    assert seen == {(1, 0, (), ()), (2, 0, (), ()), (3, 0, (), ()), (4, 200_000, (), ()), (5, 4, ((0, 3),), ("1", "null")), (None, 4, ((0, 3),), ("1", "null")), (6, 3, ((0, 2),), ("4",))}
    assert decontaminate.annotate_overlaps(none, bench).count() == 0
    assert decontaminate.annotate_overlaps(odd, bench.where("false")).where(F.size(decontaminate.SPANS) > 0).count() == 0


def test_overlap_blocks_agree(spark):
    rng = random.Random(1)
    words = [f"w{i}" for i in range(12)]
    text = lambda n: " ".join(rng.choice(words) for _ in range(n))
    items = [(i, text(rng.choice([1, 2, 5, 9, 10, 11, 14]))) for i in range(30)]
    items += [(100 + i, items[3][1]) for i in range(20)]  # windows of many items
    docs = [(i, text(rng.choice([0, 3, 40, 200])) + " " + rng.choice(items)[1], "s") for i in range(40)]
    bench, df = spark.createDataFrame(items, "item_id long, text string"), docs_of(spark, docs)
    want = {}
    for i, t, _ in docs:
        w, hit, found = t.split(), set(), set()
        for item, it in items:
            iw = it.split()
            for k in range(max(1, len(iw) - 9)):
                win = iw[k : k + 10]
                for p in range(len(w) - len(win) + 1):
                    if w[p : p + len(win)] == win:
                        hit |= set(range(p, p + len(win)))
                        found.add(str(item))
        want[i] = (len(hit), sorted(found))
    for block in (10**6, 7):
        got = {r.doc_id: (sum(b - a for a, b in r[decontaminate.SPANS]), r[decontaminate.ITEMS]) for r in decontaminate.annotate_overlaps(df, bench, block_windows=block).collect()}
        assert got == want


# chat


def test_chat_round_trip():
    for t in ("", "<|", "<\\|x", "<\\\\|<|im_end|>", "a<<|\\|", "\n\n", " é\U0001f600 <|endoftext|>"):
        assert chat.unescape(chat.escape(t)) == t and "<|" not in chat.escape(t)
    f = chat.Formatter(token_files.tokenizer_path())
    rng = random.Random(2)
    for _ in range(50):
        turns = [(rng.choice(["user", "assistant", "system", "<|im_sep|>"]), "".join(rng.choice(["\n", " ", "a", "né", "\U0001f600", "<|im_end|>", "\\", "<", "|", "the"]) for _ in range(rng.randrange(8)))) for _ in range(4)]
        text, ids, mask, spans = f.segment(turns)
        assert [(chat.unescape(a), chat.unescape(b)) for a, b in chat.TURN.findall(text)] == turns
        assert "".join(chat.unescape(text[a:b]) for a, b in spans) == "".join(t for r, t in turns if r == "assistant")
        assert len(ids) == len(mask) and f.tokenizer.decode(ids, skip_special_tokens=False) == text


def test_chat_edges(spark):
    rows = [(1, 2, "assistant", "b"), (1, 1, "user", None), (1, None, None, "first"), (None, 1, "assistant", "x"), (1, 2, "assistant", "b"), (2, 1, "assistant", LONG)] + [(3, i, "assistant", f"t{i}") for i in range(300)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("seq", F.lit(1)).withColumn("part", F.lit(2))
    got = {r.conv_id: r for r in chat.digests(chat.format_conversations(df)).collect()}
    assert got[1].n_turns == 4 and got[1].loss_sha256 == hashlib.sha256(b"bb").hexdigest()
    assert got[1].turns_sha256 == hashlib.sha256(b"\nfirst\nuser\n\nassistant\nb\nassistant\nb\n").hexdigest()
    assert got[None].loss_chars == 1 and got[2].loss_chars == len(LONG)
    assert got[3].n_turns == 300 and got[3].loss_sha256 == hashlib.sha256("".join(f"t{i}" for i in range(300)).encode()).hexdigest()
    assert chat.digests(chat.format_conversations(df.where("false"))).count() == 0


# top k


def test_topk_edges(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.0]), (1, [0.5, 0.5]), (2, [0.5, 0.1]), (3, [nan, 1.0]), (4, [inf, 1.0]), (5, None), (6, [None, 1.0]), (None, [1.0, 1.0]), (7, [1.0]), (2, [0.5, 0.1]), (8, [1e30, -1e30]), (9, [])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = sorted((r.rank, r.vec_id, r.score) for r in topk.top_k(df, df.where("vec_id = 0"), 3).collect())
    assert got == [(1, 8, (1 << 63) - 1), (2, 1, 512 * 1024), (3, 2, 512 * 1024)]
    assert topk.top_k(df.where("false"), df).count() == 0 and topk.top_k(df, df.where("false")).count() == 0


def test_topk_is_brute_force(spark):
    rng = np.random.default_rng(4)
    x = np.concatenate([rng.normal(0, 0.2, (6000, 8)), np.full((40, 8), 0.1)]).round(2)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>").coalesce(1)
    whole = np.floor(x * 1024).astype(np.int64)
    for block in (2048, 20):
        got: dict = {}
        for r in topk.top_k(df, df.where("vec_id % 100 = 0"), query_block=block).collect():
            got.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
        for q in range(0, len(x), 100):
            s = whole @ whole[q]
            order = [i for i in np.lexsort((np.arange(len(x)), -s)) if i != q][:10]
            assert sorted(got[q]) == [(k + 1, i, s[i]) for k, i in enumerate(order)]


@pytest.mark.parametrize("skew", [0, 2])
def test_topk_reads_no_more_than_it_needs(skew):
    """Blocks one after the other, with ties, a query's own row and both signs. Where components are skewed, few entries are read."""
    rng = np.random.default_rng(skew)
    x = np.floor(rng.normal(0, 1, (8192, 12)) * np.exp(skew * rng.normal(0, 1, (8192, 1))) * 64)
    x[100:140] = x[7]
    queries, names = x[:30], np.arange(30)
    best, reads = topk.Best(30, 10), np.zeros(30)
    for start in range(0, len(x), 2048):
        reads += topk.search_block(x[start : start + 2048], np.arange(start, start + 2048), queries, names, np.arange(30), best)
    for j in range(30):
        s = (x @ queries[j]).astype(int)
        assert best.found[j] == [(s[i], i) for i in np.lexsort((np.arange(len(x)), -s)) if i != j][:10]
    assert reads.max() <= 1.3 * x.size and (not skew or np.median(reads) < 0.3 * x.size)


# token files


def test_codes():
    rng = np.random.default_rng(5)
    for ids in (np.zeros(0, np.uint32), np.array([2]), np.array([0, 255, 256, 65535, 65536, 2**31]), rng.integers(0, 50257, 5000), rng.geometric(0.01, 1500)):
        ids = ids.astype(np.uint32)
        for chunk in (4, 8, 13):
            codes = token_files.Codes(token_files.pack(ids, chunk))
            assert len(codes) == len(ids) and [codes[i] for i in range(0, len(ids), 7)] == ids[::7].tolist()
            for a, b in ((0, len(ids)), (len(ids) // 3, len(ids) // 2), (len(ids) // 2, len(ids) // 2)):
                assert codes.slice(a, b).tolist() == ids[a:b].tolist()
    with pytest.raises(IndexError):
        token_files.Codes(token_files.pack(np.zeros(0, np.uint32)))[0]


def test_encoder_is_the_tokenizer():
    e = token_files.Encoder(token_files.tokenizer_path())
    rng = random.Random(6)
    parts = [" ", "  ", "\n", "\t", "a", "word", "é", ".", "'s", "<|endoftext|>", "12", "\x1c", "　", "\U0001f600", "\x85"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randrange(14))) for _ in range(1500)]
    for t, got in zip(texts, e.encode(texts), strict=True):
        assert got.tolist() == e.tokenizer.encode(t, add_special_tokens=False).ids, repr(t)


def test_encoder_is_a_fresh_tokenizer():
    from tokenizers import Tokenizer

    e, fresh = token_files.Encoder(token_files.tokenizer_path()), Tokenizer.from_file(token_files.tokenizer_path())
    rng = random.Random(7)
    parts = [" ", " ", "  ", "\n", "a", "word", ".", "<|endoftext|>", "<|endoftext|>", "<|endof", "text|>", "Été", "œuvre", "ſ", "don't", "'", ",", "_", "x,", "naïve.", "12"]
    texts = ["a <|endoftext|>b", "<|endoftext|>", "a\n<|endoftext|>\nb", *("".join(rng.choice(parts) for _ in range(rng.randrange(14))) for _ in range(3000))]
    for t, got in zip(texts, e.encode(texts), strict=True):
        assert got.tolist() == fresh.encode(t, add_special_tokens=False).ids, repr(t)
    assert e.encode(["x <|endoftext|>"])[0].tolist()[-1] == 50256


def test_token_edges(spark, odd, none):
    got = sorted(token_files.read_tokens(token_files.write_tokens(odd)).collect(), key=lambda r: r.start)
    assert [r.doc_id for r in got] == [None, 1, 2, 3, 4, 5, 5, 6]
    assert [r.start for r in got][1:] == np.cumsum([r.n_tokens for r in got])[:-1].tolist()
    assert got[1].n_tokens == 1 and got[1].ids_crc32 == zlib.crc32(b"\2\0\0\0") and got[4].n_tokens > 200_000
    assert token_files.read_tokens(token_files.write_tokens(none)).count() == 0


# toxicity


def test_toxicity(spark, odd, none):
    rng = random.Random(8)
    plain = [f"word{i}" for i in range(400)]
    text = lambda bad: " ".join([rng.choice(plain) for _ in range(60)] + (["vilestuff", "nastyword"] if bad else []))
    docs = docs_of(spark, [(i, text(i % 5 == 0), "s") for i in range(900)])
    labels = spark.createDataFrame([(i, 0, int(i % 5 == 0) if fold_of_py(i) != 1 else 1 - int(i % 5 == 0)) for i in range(900)], "doc_id long, quality int, toxic int")
    net = toxicity.fit_toxicity(docs, labels, toxicity.may_learn())
    got = toxicity.score_toxicity(docs, net).select("doc_id", toxicity.SCORE).collect()
    assert sum((r[1] >= 0.7) == (r.doc_id % 5 == 0) for r in got if fold_of_py(r.doc_id) == 1) >= 0.98 * sum(fold_of_py(i) == 1 for i in range(900))
    scored = toxicity.score_toxicity(odd, net)
    assert scored.columns == [*[c for c in odd.columns if c != toxicity.SCORE], toxicity.SCORE] and scored.count() == odd.count()
    assert all(0 <= r[0] <= 1 for r in scored.select(toxicity.SCORE).collect())
    assert toxicity.score_toxicity(none, net).count() == 0
    assert toxicity.fit_toxicity(docs, labels.where("false"), toxicity.may_learn()) is None
    assert {r[0] for r in toxicity.score_toxicity(odd, None).select(toxicity.SCORE).collect()} == {0.0}


def fold_of_py(i, n=3):
    return zlib.crc32(str(i).encode()) % n


def test_toxicity_sample_is_bounded(spark, monkeypatch):
    """A repeated id, a text of too many words and a very long word: what comes to the driver stays within the bounds."""
    rng, most, came = random.Random(9), 8_000, []
    plain = [(i, " ".join(f"w{rng.randrange(200)}" for _ in range(20)) + " vile" * (i % 5 == 0), "s") for i in range(300)]
    plain[9] = (9, "y" * 3_000_000 + " w1", "s")
    labels = spark.createDataFrame([(i, int(i % 5 == 0)) for i in range(302)], "doc_id long, toxic int")
    extra = [(7, plain[7][1], "s")] * 2_000 + [(301, LONG, "s")]
    to_arrow = type(labels).toArrow
    monkeypatch.setattr(type(labels), "toArrow", lambda self: came.append(to_arrow(self)) or came[-1])
    nets = [toxicity.fit_toxicity(docs_of(spark, r), labels, F.lit(True), sample_words=most) for r in (plain, plain + extra)]
    assert all(t.num_rows <= 302 for t in came) and sum(t.nbytes for t in came) < 4 * 34 * most
    assert all(np.allclose(getattr(nets[0], k), getattr(nets[1], k), atol=1e-4) for k in ("table", "filters", "thresholds"))
    long = "ü" * 40
    assert toxicity.rows_of(toxicity.packed_word(long.encode())) == toxicity.rows_of(long.encode())


def test_score_depends_on_the_text_alone():
    rng = np.random.default_rng(0)
    net = toxicity.Network(rng.normal(0, 1, (toxicity.ROWS, toxicity.DIM)).astype(np.float32), rng.normal(0, 1, (toxicity.FEATURES * toxicity.DIM, len(toxicity.SLOTS) * toxicity.FILTERS)).astype(np.float32), np.zeros(toxicity.POOLED, np.float32), np.ones(toxicity.POOLED, np.float32), -3.0)
    texts = [b"a b c", b"", b"a", b"x y z " * 50, b"c b a", b"zz"]
    alone = [toxicity.Scorer(net).scores([t])[0] for t in texts]
    for at_once in (1, 7, 10**6):
        assert np.allclose(toxicity.Scorer(net).scores(texts, at_once), alone, rtol=1e-4)


def slow_logit(net, words):
    """Every filter at every place of one text, one after the other."""
    table = [np.concatenate([net.table[r] for r in toxicity.rows_of(w)]).astype(float) for w in words] + [np.tile(net.table[0], toxicity.FEATURES).astype(float)] * max(toxicity.WIDTHS)
    out, column = float(net.out_bias), 0
    for k, width in enumerate(toxicity.WIDTHS):
        for f in range(toxicity.FILTERS):
            answers = [sum(table[p + j] @ net.filters[:, (column + j) * toxicity.FILTERS + f] for j in range(width)) for p in range(len(words) + 1)]
            out += max(0.0, max(answers) + net.bias[k * toxicity.FILTERS + f]) * net.out[k * toxicity.FILTERS + f]
        column += width
    return out


def test_toxicity_is_a_slow_convolution():
    rng = np.random.default_rng(5)
    table = rng.normal(0, 1, (toxicity.ROWS, toxicity.DIM)).astype(np.float32)
    table[0] = 0
    net = toxicity.Network(table, rng.normal(0, 1, (toxicity.FEATURES * toxicity.DIM, len(toxicity.SLOTS) * toxicity.FILTERS)).astype(np.float32), rng.normal(0, 1, toxicity.POOLED).astype(np.float32), rng.normal(0, 1, toxicity.POOLED).astype(np.float32), 0.3)
    net.thresholds[:] = (0.5, -1, 2, 0)
    for text in ("", "one", "one two", "Größe über alles, Straße", "ça où le garçon", "a b c d e f g a b c"):
        words = re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", re.sub("[A-Z]", lambda m: m[0].lower(), text))
        z = slow_logit(net, [w.encode() for w in words]) - net.thresholds[toxicity.language_of(text.encode())]
        assert np.isclose(toxicity.Scorer(net).scores([text.encode()])[0], 1 / (1 + np.exp(-z - np.log(0.7 / 0.3))), rtol=1e-3, atol=1e-6)


# near duplicates


def slow_components(rows, k, percent):
    sets = {}
    for i, t in rows:
        w = [x.decode() for x in spaced_words((t or "").encode())]
        sets[i] = {tuple(w[j : j + k]) for j in range(max(1, len(w) - k + 1))} if w else set()
    label = {i: i for i, _ in rows}

    def find(i):
        while label[i] != i:
            i = label[i]
        return i

    ids = list(sets)
    for a in range(len(ids)):
        for b in range(a):
            x, y = sets[ids[a]], sets[ids[b]]
            if x and y and 100 * len(x & y) >= percent * len(x | y):
                i, j = find(ids[a]), find(ids[b])
                label[max(i, j)] = min(i, j)
    return {i: (len(sets[i]), find(i)) for i in ids}


@pytest.mark.parametrize(("k", "percent"), [(3, 85), (5, 80)])
def test_near_duplicates_are_brute_force(spark, k, percent):
    rng = random.Random(9)
    rows, words = [], [f"w{i}" for i in range(300)]
    for g in range(12):
        base = [rng.choice(words) for _ in range(rng.choice([1, 2, 4, 30, 80, 200]))]
        for _ in range(10):
            copy = list(base)
            for _ in range(rng.randrange(4)):
                copy[rng.randrange(len(copy))] = rng.choice(words)
            rows.append((len(rows) * 7 % 1009, " ".join(copy)))
    got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in near_dups.near_duplicates(docs_of(spark, [(*r, "s") for r in rows]), k, percent).collect()}
    assert got == {i: (n, c, i == c) for i, (n, c) in slow_components(rows, k, percent).items()}


def test_near_duplicate_edges(spark, odd, none):
    got = [(r.doc_id, r.n_shingles, r.component_id, r.kept) for r in near_dups.near_duplicates(odd, 3, 85).collect()]
    assert sorted(got, key=str) == sorted([(1, 0, 1, True), (2, 0, 2, True), (3, 0, 3, True), (4, 1, 4, True), (5, 2, 5, True), (5, 2, 5, True), (None, 2, None, True), (6, 1, 6, True)], key=str)
    assert near_dups.near_duplicates(none).count() == 0


def test_near_duplicates_of_many_documents_are_an_exact_join(spark):
    """10,500 documents: pairs, one large group of near copies, and documents of which most share a passage."""
    rng = random.Random(4)
    vocabulary = [f"v{i}" for i in range(5000)]
    some = lambda n: [rng.choice(vocabulary) for _ in range(n)]

    def changed(words, most):
        words = list(words)
        for _ in range(rng.randrange(most + 1)):
            words[rng.randrange(len(words))] = rng.choice(vocabulary)
        return words

    base, passage, texts = some(90), some(60), []
    texts += [changed(base, 6) for _ in range(500)]
    texts += [passage + some(rng.randrange(4, 40)) for _ in range(600)]
    for _ in range(3000):
        one = some(rng.randrange(10, 70))
        texts += [one, changed(one, 4)]
    texts += [some(rng.randrange(1, 60)) for _ in range(10_500 - len(texts))]
    rng.shuffle(texts)
    sets = [frozenset(tuple(w[j : j + 3]) for j in range(max(1, len(w) - 2))) for w in texts]
    by_shingle, label = {}, list(range(len(texts)))
    for i, s in enumerate(sets):
        for x in s:
            by_shingle.setdefault(x, []).append(i)

    def find(i):
        while label[i] != i:
            label[i] = i = label[label[i]]
        return i

    for i, s in enumerate(sets):
        met: dict = {}
        for x in s:
            for j in by_shingle[x]:
                if j < i:
                    met[j] = met.get(j, 0) + 1
        for j, n in met.items():
            if 100 * n >= 85 * (len(s) + len(sets[j]) - n):
                a, b = find(i), find(j)
                label[max(a, b)] = min(a, b)
    docs = docs_of(spark, [(i, " ".join(w), "s") for i, w in enumerate(texts)])
    got = {r.doc_id: r.component_id for r in near_dups.near_duplicates(docs, 3, 85).collect()}
    assert got == {i: find(i) for i in range(len(texts))}


def test_components(spark):
    rng = random.Random(1)
    for n, m in ((1, 0), (40, 25), (200, 180)):
        edges = [(rng.randrange(n), rng.randrange(n)) for _ in range(m)] + ([(i, i + 1) for i in range(500, 530)] if n > 1 else [])
        label: dict = {}
        for a, b in edges:
            x, y = label.setdefault(a, {a}), label.setdefault(b, {b})
            if x is not y:
                x |= y
                for i in y:
                    label[i] = x
        got = {r.node: r.root for r in components.connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
        for a in got:
            assert {i for i in got if got[i] == got[a]} == label[a] & set(got)
        assert set(got) >= {i for e in edges for i in e if e[0] != e[1]}


# lines


def test_line_edges(spark, odd, none):
    got = lines.dedup_lines(odd, min_docs=2).collect()
    seen = sorted(((r.doc_id, r.n_lines, r.n_dropped, r.kept_text) for r in got if r.doc_id != 4), key=str)
    assert seen == sorted([(1, 1, 0, ""), (2, 1, 0, ""), (3, 2, 0, " \n\t "), *[(i, 1, 0, "one two three four") for i in (5, 5, None)], (6, 1, 0, "Ünï çode ß")], key=str)  # one document: rows of doc 5 count once, a row without an id not at all
    assert lines.dedup_lines(none).count() == 0


def test_lines_are_brute_force(spark):
    rng = random.Random(3)
    pool = ["Foo ", " foo", "\tFOO\r", "", " ", "bar", "BÄR", "bär", "x\x1c"] + [f"l{i}" for i in range(30)]
    rows = [(i, "\n".join(rng.choice(pool) for _ in range(rng.randrange(1, 6)))) for i in range(60)]
    key = lambda s: re.sub("[A-Z]", lambda m: m[0].lower(), s.strip(" \t\n\x0b\x0c\r"))
    seen: dict = {}
    for _, t in rows:
        for k in {key(s) for s in t.split("\n")}:
            seen[k] = seen.get(k, 0) + 1
    got = {r.doc_id: (r.n_lines, r.n_dropped, r.kept_text) for r in lines.dedup_lines(docs_of(spark, [(*r, "s") for r in rows])).collect()}
    for i, t in rows:
        all_ = t.split("\n")
        left = [s for s in all_ if not (key(s) and seen[key(s)] >= 10)]
        assert got[i] == (len(all_), len(all_) - len(left), "\n".join(left))


def test_lines_count_documents_not_rows(spark):
    same = [(1, "a line\nx", "s")] * 10 + [(None, "a line", "s")] * 3
    assert {r.n_dropped for r in lines.dedup_lines(docs_of(spark, same)).collect()} == {0}
    ten = docs_of(spark, [(i, "a line\nx" if i else "a line", "s") for i in range(10)] + [(None, "a line\ny", "s")])
    assert {(r.doc_id, r.n_dropped, r.kept_text) for r in lines.dedup_lines(ten, 10).collect()} == {(i, 1, "x" if i else "") for i in range(10)} | {(None, 1, "y")}


# language model


def test_lm_edges(spark, odd, none):
    got = lm.score_documents(odd, fold_of("doc_id", 7) != 2).collect()
    assert len(got) == odd.count() and all(np.isfinite([r.base_score, r.score]).all() for r in got)
    assert {r.n_tokens for r in got if r.doc_id in (1, 2, 3)} == {1}
    assert lm.score_documents(none, fold_of("doc_id", 7) != 2).count() == 0
    untrained = lm.score_documents(odd, F.lit(False)).collect()
    assert {(r.n_known, r.train_tokens, r.base_score) for r in untrained} == {(0, 0, 0.0)}


def test_lm_counts_and_shards(spark):
    import math
    from collections import Counter

    rng = random.Random(5)
    rows = [(i, " ".join(f"w{min(int(rng.paretovariate(0.7)), 400)}" for _ in range(rng.randrange(80)))) for i in range(120)]
    df = docs_of(spark, [(*r, "s") for r in rows])
    train = Counter(t for i, x in rows if fold_of_py(i, 7) != 2 for t in [*x.split(), None])
    n, v = sum(train.values()), len(train)
    want = {i: (len(x.split()) + 1, sum(train[t] > 0 for t in [*x.split(), None]), sum(math.log10((train[t] + 1) / (n + v + 1)) for t in [*x.split(), None])) for i, x in rows}
    pairs = Counter(p for i, x in rows if fold_of_py(i, 7) != 2 for p in zip(["<s>", *x.split()], [*x.split(), None], strict=True))
    n_docs = sum(fold_of_py(i, 7) != 2 for i, _ in rows)
    least, most = (lambda c: 2 ** (c.bit_length() - 1) if c else 0), (lambda c: 2 ** c.bit_length() - 1)
    mass = sum((least(c) + most(c)) / 2 + 1 for c in train.values()) + 1

    def chance(before, word):
        alone = ((least(train[word]) + most(train[word])) / 2 + 1) / mass
        under = n_docs if before == "<s>" else most(train[before])
        return 0.4 * alone + 0.6 * min(1, least(pairs[before, word]) / under) if under else alone

    assert all(sum(chance(b, w) for w in train) <= 1 for b in ["<s>", *train])
    scores = {i: sum(math.log10(chance(*p)) for p in zip(["<s>", *x.split()], [*x.split(), None], strict=True)) for i, x in rows}
    for filter_bytes, hot, part_bytes in ((1 << 27, 10**6, 1 << 20), (1, 3, 2000), (1, 3, 150)):  # broadcast; dealt, in one run of parts and in several
        got = {r.doc_id: r for r in lm.score_documents(df, fold_of("doc_id", 7) != 2, filter_bytes, hot, 4000.0, part_bytes).collect()}
        for i, (tokens, known, base) in want.items():
            assert (got[i].n_tokens, got[i].n_known, got[i].train_tokens) == (tokens, known, n) and abs(got[i].base_score - base) <= 1e-9 * abs(base)
            assert abs(got[i].score - scores[i]) <= 1e-9 * abs(scores[i]) and got[i].score <= 0


def test_filter_holds_every_count():
    keys = lm.mixed(np.arange(1, 40_001, dtype=np.uint64))
    counts = np.random.default_rng(2).geometric(0.2, 40_000)
    part = lm.part_of(keys, 3)
    table = lm.FilterShard(3, [(p, lm.bits_of(keys[part == p], counts[part == p], lm.BITS_PER_ENTRY)) for p in range(3)])
    out, others = np.zeros(len(keys), np.uint8), np.zeros(40_000, np.uint8)
    table.fill(keys, out)
    assert (out >= lm.level_of(counts)).all() and (out == lm.level_of(counts)).mean() > 0.97
    table.fill(lm.mixed(np.arange(10**6, 10**6 + 40_000, dtype=np.uint64)), others)
    assert (others > 0).mean() < 0.025


def test_sums_keep_distinct_keys():
    sums, rng = lm.Sums(), np.random.default_rng(3)
    for _ in range(40):
        keys = np.unique(rng.integers(0, 1000, 60_000).astype(np.uint64))
        sums.add(keys, np.ones(len(keys), np.int64))
        assert sums.held <= lm.AT_ONCE + 1000
    assert (sums.total()[1] == 40).all() and len(sums.total()[0]) == 1000


# mixing


def test_mix_edges(spark, odd, none):
    plan = mixing.plan_mix(odd).collect()
    assert len(plan) == odd.count() and {r.copies for r in plan if r.n_words == 0} == {0}
    assert mixing.plan_mix(none).count() == 0 and mixing.mix(none).columns == none.columns
    assert set(mixing.mix(odd).columns) == set(odd.columns)


def test_mix_meets_targets(spark):
    rows = [(i, " ".join(["w"] * (1 + i % 40)), "big" if i % 10 else ("small" if i % 20 else None)) for i in range(3000)]
    df = docs_of(spark, rows)
    for how in ({"target_entropy": 0.9, "max_repeats": 100.0}, {"target_entropy": 1.0, "max_repeats": 2.0}, {"target_entropy": 0.0, "max_repeats": 100.0}):
        plan = mixing.plan_mix(df, block_docs=50, **how).toPandas()
        plan["source"] = plan["source"].fillna("null")
        words, mixed = plan.groupby("source").n_words.sum(), (plan.n_words * plan.copies).groupby(plan.source).sum()
        share = mixed / mixed.sum()
        entropy = -(share * np.log(share)).sum() / np.log(3)
        assert abs(mixed.sum() - words.sum()) < 200
        assert (mixed / words).max() <= how["max_repeats"] + 0.1
        assert entropy >= how["target_entropy"] - 0.02 or abs((mixed / words).max() - how["max_repeats"]) < 0.1
        if not how["target_entropy"]:
            assert (plan.copies == 1).all()
        assert (plan.groupby("source").copies.max() - plan.groupby("source").copies.min()).max() <= 1


@pytest.mark.parametrize(("target", "limit"), [(0.97, 4.0), (0.6, 100.0), (0.3, 1.05), (0.999, 4.0)])
def test_mix_meets_a_target_on_either_side(spark, target, limit):
    """Sources nearly even: most targets ask for an exponent over 1."""
    rows = [(i, " ".join(["w"] * (5 + i % 7)), f"s{i % 5}") for i in range(3000) if i % 5 or i % 3]
    words = {}
    for _, t, s in rows:
        words[s] = words.get(s, 0) + len(t.split())
    share = np.array([words[s] for s in sorted(words)]) / sum(words.values())

    def weights(a):
        p = share**a
        return p / p.sum()

    entropy = lambda p: -(p * np.log(p)).sum() / np.log(len(p))
    low, high = 0.0, 64.0
    for _ in range(60):
        a = (low + high) / 2
        low, high = (a, high) if entropy(weights(a)) >= target and (weights(a) / share).max() <= limit else (low, a)
    plan = mixing.plan_mix(docs_of(spark, rows), target, limit, block_docs=64).toPandas()
    got = (plan.n_words * plan.copies).groupby(plan.source).sum() / sum(words.values())
    assert np.abs(got.to_numpy() - weights(low)).max() < 0.005
    assert plan.copies.nunique() > 1 and (low > 1) == (target < 0.99)
    mixed = mixing.mix(docs_of(spark, rows), target_entropy=target, max_repeats=limit, block_docs=64)
    assert {r.doc_id: r["count"] for r in mixed.groupBy("doc_id").count().collect()} == {d: c for d, c in zip(plan.doc_id, plan.copies) if c}


def test_mixing_stage_of_uneven_sources(spark, tmp_path):
    """What the stage keeps, and how often, is what the plan says; sources of very different sizes come nearer to each other."""
    rows = [(i, f"text {i} of some words", "big" if i % 8 else f"small{i % 24}") for i in range(1200)]
    docs = docs_of(spark, rows)
    kept = corpus_pipeline.mix_sources(spark, docs, str(tmp_path)).groupBy("doc_id", "source").count().toPandas()
    plan = mixing.plan_mix(docs).where("copies > 0").toPandas()
    assert dict(zip(kept.doc_id, kept["count"])) == dict(zip(plan.doc_id, plan.copies))
    totals = kept.groupby("source")["count"].sum()
    assert totals["big"] < 1050 and totals.drop("big").min() > 100


# the pipeline


def test_stages(spark, odd, none, tmp_path):
    spark.createDataFrame([(1, 0, 0), (None, None, None)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame([(1, "four five"), (2, None)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    for name, stage in corpus_pipeline.STAGES:
        for docs in (odd, none):
            out = stage(spark, docs, str(tmp_path))
            n = out.count()
            assert n if docs is odd else not n, name
            assert out.columns == docs.columns or name == "token_ids"
    kept = corpus_pipeline.drop_near_duplicates(spark, odd, str(tmp_path))
    assert sorted(str(r.doc_id) for r in kept.collect()) == ["1", "2", "3", "4", "5", "6", "None"]


def test_stage_decisions(spark, tmp_path):
    bench = "alpha beta gamma delta epsilon zeta eta theta iota kappa"
    spark.createDataFrame([(1, bench)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    docs = docs_of(spark, [(1, f"x {bench} y", "a"), (2, "clean words here", "a"), (3, "clean words here", "a")])
    assert [r.doc_id for r in corpus_pipeline.drop_contaminated(spark, docs, str(tmp_path)).collect()] == [2, 3]
    assert sorted(r.doc_id for r in corpus_pipeline.drop_near_duplicates(spark, docs, str(tmp_path)).collect()) == [1, 2]
    twice = docs_of(spark, [(3, "one two three four five six", "a"), (5, "one two three four five six", "a"), (5, "other words than those of three", "a"), (5, "other words than those of three", "a"), (6, "", "a"), (6, "", "a")])
    kept = sorted((r.doc_id, r.text) for r in corpus_pipeline.drop_near_duplicates(spark, twice, str(tmp_path)).collect())
    assert kept == [(3, "one two three four five six"), (5, "other words than those of three"), (6, ""), (6, "")]


def test_run_is_its_stages_one_by_one(spark, tmp_path):
    """All of run() against plain Python: the toxic, the copies and the benchmark go, what stays is encoded in order of doc_id."""
    from tokenizers import Tokenizer

    rng = random.Random(12)
    words = [f"word{i}" for i in range(300)]
    text = lambda bad=False: " ".join([rng.choice(words) for _ in range(50)] + (["vilestuff", "nastyword"] if bad else []))
    bench = " ".join(words[:12])
    docs = [(i, text(i % 5 == 0), "a" if i % 2 else "b") for i in range(600)]
    copies = [(1000 + i, docs[i][1], "a") for i in (1, 2, 3)]
    dirty = [(2000, f"{text()} {bench} end", "b")]
    docs_of(spark, [*docs, *copies, *dirty]).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(i, 0, int(i % 5 == 0)) for i in range(600)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame([(1, bench)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    got = sorted(corpus_pipeline.run(spark, str(tmp_path)).collect(), key=lambda r: r.start)
    tokenizer, start = Tokenizer.from_file(token_files.tokenizer_path()), 0
    texts = {i: t for i, t, _ in docs if i % 5}
    assert [r.doc_id for r in got] == sorted(texts)  # two even sources: mixing keeps all
    for r in got:
        ids = [*tokenizer.encode(texts[r.doc_id], add_special_tokens=False).ids, token_files.END_ID]
        assert (r.start, r.n_tokens, r.ids_crc32) == (start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)
