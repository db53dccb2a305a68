"""The queries without SQL, column by column against plain Python, on the driver's documents and odd ones."""

import hashlib
import math
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pyarrow.parquet
import pytest
from tokenizers import Tokenizer

from quizweave.llm import lm, secrets, token_files, toxicity

from ..compare import SF
from .test_edges import slow_logit

ODD = [
    None, "", " \n\t ", "<|endoftext|> and <|endoftext|>", "word " * 3_000, "Ünï çode ß 漢字 \U0001f600 " * 5,
    'PASSWORD = "hunter2xyz" token:short api-key="abcdef/123+x==" secret:abc apikey=abc123é', "AKIA" + "A1B2C3D4" * 3 + " AKIAA1B2 " + "deadbeef" * 4 + "g" + "0" * 23,
    "é😀 secret=" + "0123456789abcdef" * 2 + " passwd" + "'" + ":  " + "A" * 40, "token=token=abcdefgh", "password=abc password='abcdefg'",
]


@pytest.fixture(scope="module")
def made(tmp_path_factory):
    """A folder of tables; (doc_id, text) of its documents."""
    folder = tmp_path_factory.mktemp("made")
    docs = pa.parquet.read_table(f"{SF}/documents.parquet", columns=["doc_id", "text"]).to_pylist()
    rows = [(d["doc_id"], d["text"]) for d in docs]
    rows += [(10_000 + i, t) for i, t in enumerate(ODD)]
    rows.append(rows[0])  # an equal row
    pa.parquet.write_table(pa.table({"doc_id": pa.array([r[0] for r in rows], pa.int64()), "text": pa.array([r[1] for r in rows], pa.string())}), folder / "documents.parquet")
    pa.parquet.write_table(pa.parquet.read_table(f"{SF}/labels.parquet"), folder / "labels.parquet")
    return str(folder), rows


def fold(doc_id, n):
    return zlib.crc32(str(doc_id).encode()) % n


def lowered(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def same(df, want, *columns):
    key = lambda r: tuple(map(str, r))
    got = sorted((tuple(r) for r in df.select(*columns).collect()), key=key)
    assert got == sorted(want, key=key)


def test_op1(spark, made):
    folder, rows = made
    word = r"(?:[Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])"
    patterns = [("assign", word + r"""["']? *[:=] *["']?([A-Za-z0-9+/_.=-]+)""", 6), ("access", "(AKIA[A-Z0-9]+)", 20), ("hex", "([0-9a-f]+)", 24)]
    want, some = [], Counter()
    for doc_id, text in rows:
        spans = [(m.start(), i, m.end(), kind) for i, (kind, p, least) in enumerate(patterns) for m in re.finditer(p, text or "") if len(m[1]) >= least]
        n = Counter(s[3] for s in spans)
        some += n
        joined = ",".join(f"{kind}:{start}:{end}" for start, _, end, kind in sorted(spans))
        want.append((doc_id, n["assign"], n["access"], n["hex"], hashlib.sha256(joined.encode()).hexdigest()))
    assert len(some) == 3
    same(secrets.op1_secret_scan(spark, folder), want, "doc_id", "n_assign", "n_access", "n_hex", "base_sha256")


def test_op5(spark, made):
    folder, rows = made
    model = Tokenizer.from_file(token_files.tokenizer_path())
    want, start = [], 0
    for doc_id, text in sorted(rows, key=lambda r: r[0]):
        ids = [*model.encode(text or "", add_special_tokens=False).ids, 2]
        want.append((doc_id, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    same(token_files.op5_token_ids(spark, folder), want, "doc_id", "start", "n_tokens", "ids_crc32")


def test_op6(spark, made):
    folder, rows = made
    docs, labels = spark.read.parquet(f"{folder}/documents.parquet"), spark.read.parquet(f"{folder}/labels.parquet")
    net = toxicity.fit_toxicity(docs, labels, toxicity.may_learn())
    got = toxicity.op6_toxicity(spark, folder).collect()
    assert sorted(r.doc_id for r in got) == sorted(r[0] for r in rows)
    texts = dict(rows)
    for r in got:
        assert r.held_out == (fold(r.doc_id, 3) == 1) and r.predicted == int(r.score >= 0.7)
        text = texts[r.doc_id] or ""
        words = [w.encode() for w in re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", lowered(text))]
        if len(words) <= 200 or r.doc_id >= 10_000:
            z = slow_logit(net, words) - net.thresholds[toxicity.language_of(text.encode())]
            assert math.isclose(r.score, 1 / (1 + math.exp(-z - math.log(0.7 / 0.3))), rel_tol=1e-3, abs_tol=1e-5)


def test_op9(spark, made):
    folder, rows = made
    tokens = {i: [*re.findall("[^\x20\x09-\x0d]+", lowered(text)), None] for i, text in rows}  # None: the end
    counts = Counter(t for i, _ in rows if fold(i, 7) != 2 for t in tokens[i])
    n, v = sum(counts.values()), len(counts)
    got = lm.op9_lm_score(spark, folder).collect()
    assert sorted(r.doc_id for r in got) == sorted(r[0] for r in rows)
    for r in got:
        mine = tokens[r.doc_id]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (fold(r.doc_id, 7) == 2, len(mine), sum(counts[t] > 0 for t in mine), n)
        assert math.isclose(r.base_score, sum(math.log10((counts[t] + 1) / (n + v + 1)) for t in mine), rel_tol=1e-9)
        assert math.isfinite(r.score) and r.score < 0
