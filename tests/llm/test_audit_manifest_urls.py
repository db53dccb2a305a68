"""Filter audit, Merkle manifest and url filters against plain Python that shares no code with them."""

import hashlib
import random
import re
import zlib
from itertools import permutations

import numpy as np
import pytest
from pyspark.sql import functions as F

from quizweave.llm import manifest, survival, url_filters

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
CLASHING = ("part", "digest", "failed", "least", "held", "subset", "n", "toxic", "quality", "tree", "rank", "total", "leaf", "given", "row", "local", "block", "rows", "host", "path", "rule", "listed", "keys", "a", "b", "key")


def clash(df):
    return df.select("*", *[F.lit("x").alias(c) for c in CLASHING])


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


# filter audit


@pytest.mark.parametrize("n", [0, 1, 2, 3, 7, 100, 1001])
def test_popcounts_by_carry_save(n):
    words = np.random.default_rng(n).integers(0, 1 << 32, n, dtype=np.uint32)
    assert survival.positional_popcounts(words, 32).tolist() == [sum(int(w) >> i & 1 for w in words) for i in range(32)]


def test_words_hold_the_subsets_that_are_survived():
    words = survival.survival_words(5)
    for failed in range(32):
        assert [int(words[failed]) >> s & 1 for s in range(32)] == [int(failed & s == 0) for s in range(32)]


def odd_docs():
    rng = random.Random(5)
    long = " ".join(f"w{i}" for i in range(250))
    texts = [None, "", " \x0b\t", long, long, long.upper(), "a " * 300, "$ " + long, "Ünï ÇODE " * 80, long + " &", "\u00a0".join(["x"] * 300), "wort " * 100_000]
    rows = [(i, t, rng.choice(["en", "de", None, ""]), rng.choice(["s", "t", None]), len(t or "")) for i, t in enumerate(texts * 3)]
    rows += [rows[3], rows[3], (None, long, "en", None, 5), (None, None, None, "s", None), (7, "other text", "de", "", 1)]
    return rows


def slow_audit(rows, labels):
    good, toxic = ({i for i, *v in labels if i is not None and v[k] == 1} for k in range(2))

    def fails(doc):
        i, t = doc[0], doc[1] or ""
        words = re.findall("[^\x20\x09-\x0d]+", t)
        return {
            "A": len(words) < 200,
            "B": 100 * len(set(words)) < 50 * len(words),
            "C": 100 * len(re.findall("[A-Z]", t)) > 3 * len(t),
            "D": bool(re.search("[#$%&*|]", t)),
            "E": i is not None and any(r[0] is not None and r[0] < i and (r[1] or "") == t for r in rows),
        }

    judged = [(r[2] or "", r[0], fails(r)) for r in rows]
    out, whole = [], {}
    for part in {p for p, _, _ in judged}:
        for order in permutations("ABCDE"):
            left = [(i, f) for p, i, f in judged if p == part]
            gone = []
            for step, name in enumerate(order, 1):
                here = [x for x in left if x[1][name]]
                left = [x for x in left if not x[1][name]]
                redundant = sum(f[name] for _, f in gone)
                unique = sum(f[name] and sum(f.values()) == 1 for p, _, f in judged if p == part)
                gone += here
                whole[part, name] = whole.get((part, name), 0) + len(here)
                out.append([part, "".join(order), step, len(left), len(here), redundant, unique, sum(i in good for i, _ in here), sum(i in toxic for i, _ in here), name])
    return sorted((*r[:-1], whole[r[0], r[-1]]) for r in out)


def test_audit_is_filtering_step_by_step(spark):
    rows = odd_docs()
    labels = [(i, i % 2, i % 3 == 0) for i in range(30)] + [(3, 1, 1), (None, 1, 1), (4, None, None)]
    labels = [(i, q, None if t is None else int(t)) for i, q, t in labels]
    docs, given = spark.createDataFrame(rows, DOCS), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    merged = {}
    for i, q, t in labels:
        a = merged.setdefault(i, [0, 0])
        a[0], a[1] = max(a[0], q or 0), max(a[1], t or 0)
    want = slow_audit(rows, [(i, *v) for i, v in merged.items()])
    assert sorted(map(tuple, survival.audit_filters(clash(docs), given).collect())) == want
    assert survival.audit_filters(docs.where("false"), given).count() == 0
    assert survival.audit_filters(docs, given.where("false")).agg(F.sum("quality_lost")).first()[0] == 0


# manifest


def slow_tree(leaves):
    """Nodes in postorder by (level, index), and for each leaf its siblings by level."""
    levels = [list(leaves)]
    while len(levels[-1]) > 1:
        levels.append([sha("".join(levels[-1][i : i + 16])) for i in range(0, len(levels[-1]), 16)])
    order = []

    def visit(level, i):
        if level:
            for j in range(16 * i, min(16 * i + 16, len(levels[level - 1]))):
                visit(level - 1, j)
        order.append((level, i))

    visit(len(levels) - 1, 0)
    paths = []
    for leaf in range(len(leaves)):
        path, i = [], leaf
        for level in levels[:-1]:
            start = i - i % 16
            path.append((i - start, [x for j, x in enumerate(level[start : start + 16]) if j != i - start]))
            i //= 16
        paths.append(path)
    return levels[-1][0], levels, order, paths


@pytest.mark.parametrize("n", [1, 2, 15, 16, 17, 255, 256, 257, 300, 4096, 4113, 8500])
def test_positions_are_a_walk_in_postorder(n):
    _, levels, order, _ = slow_tree([sha(str(i)) for i in range(n)])
    assert [manifest.position(level, i, n) for level, i in order] == list(range(len(order)))
    log = []
    for block in range(-(-n // 256)):
        part = manifest.append_block(block, [bytes.fromhex(x) for x in levels[0][block * 256 : block * 256 + 256]], n)
        assert [manifest.position(level, i, n) for level, i, _ in part] == list(range(manifest.position(0, block * 256, n), manifest.position(0, block * 256, n) + len(part)))
        log += part
    assert all(levels[level][i] == d.hex() for level, i, d in log)


def slow_manifest(rows, tampered):
    def leaf(i, t, lang, source, n):
        return sha("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in (i, source, lang, n, t)))

    trees = {}
    for r in rows:
        trees.setdefault(r[3], []).append((r[0], leaf(*r), r))
    names = sorted(trees, key=lambda s: (s is not None, (s or "").encode()))
    for name in names:
        trees[name].sort(key=lambda x: (x[0] is not None, x[0] or 0, bytes.fromhex(x[1])))
    built = {name: slow_tree([x[1] for x in trees[name]]) for name in names}
    root, _, _, top_paths = slow_tree([built[name][0] for name in names])
    out = []
    for name, top in zip(names, top_paths, strict=True):
        for (i, own, r), path in zip(trees[name], built[name][3], strict=True):
            whole = path + top
            changed = re.sub("[A-Z]", lambda m: m[0].lower(), r[1]) if r[1] is not None else None
            now = leaf(r[0], changed, *r[2:]) if tampered(i) else own
            for place, others in whole:
                now = sha("".join([*others[:place], now, *others[place:]]))
            out.append((i, own, built[name][0], root, sha("".join(x for _, level in whole for x in level)), now, now == root))
    return sorted(out, key=str)


def crc_tampers(i):
    return i is not None and zlib.crc32(str(i).encode()) % 5 == 0


def of_spark(docs):
    tampered = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0
    made, upper = manifest.build_manifest(manifest.dataset_leaves(docs, tampered), "tree", ["doc_id", "leaf"])
    return sorted(map(tuple, manifest.prove(made, docs.schema["doc_id"].dataType).collect()), key=str), upper


def test_manifest_of_odd_rows(spark):
    rows = odd_docs() + [(100 + i, f"Text {i}", None, "big", 1) for i in range(700)] + [(5000 + i, f"T{i}", "en", f"src{i}", None) for i in range(300)]
    got, _ = of_spark(clash(spark.createDataFrame(rows, DOCS)))
    want = slow_manifest(rows, crc_tampers)
    assert got == want and {r[-1] for r in got} == {True, False}
    assert of_spark(spark.createDataFrame(rows[:1], DOCS))[0] == slow_manifest(rows[:1], crc_tampers)
    assert of_spark(spark.createDataFrame([], DOCS))[0] == []


def test_manifest_of_a_tall_tree(spark):
    """66,000 leaves: two rounds of builders over the blocks."""
    rows = [(i, f"Doc {i % 100}", None, "one", None) for i in range(66_000)]
    docs = spark.range(66_000).select(F.col("id").alias("doc_id"), F.concat(F.lit("Doc "), F.col("id") % 100).alias("text"), F.lit(None).cast("string").alias("lang"), F.lit("one").alias("source"), F.lit(None).cast("long").alias("n_chars"))
    got, upper = of_spark(docs)
    assert got == slow_manifest(rows, crc_tampers)
    assert upper.where("level > 2").count() == 17 + 2 + 1  # of 258 blocks


# url filters

URLS = [
    None, "", "no scheme", "://", "http://", "http:///en/x", "HTTP://WWW.Example.NET/en/1?x#y", "http://example.net/EN/1", "http://notexample.net/en/", "http://example.net", "http://example.net?/en/", "http://a.example.com/de/1",
    "http://a.example.com/de", "http://x.org/fr/", "http://org/fr/1", "a://b://c/d", "http://cheap-pills.example.com/en/1", "http://x.cheap-pills.example.com", "http://x.cheap-pills.example.net/fr/", "http://cheap-pills./x", "http://..a..b/",
    "http://user@example.net:80/en/", "http://thin.example.com/a?1", "http://thin.example.com/a#2", "http://thin.example.com/b", "http://ÜX.example.org/fr/é", "http://a\nb.net/x\ny?z", "http://net/", "http://net", "http://" + "a." * 60_000 + "net/en/",
    "http://" + "x" * 400 + ".casino-win.example.org/", "http://casino-win." + "y" * 300 + ".org/", "http://example.org/" + "p" * 100_000,
]


def slow_verdict(url, listed):
    host = path = ""
    if url is not None and "://" in url:
        rest = url[url.index("://") + 3 :]
        end = min([rest.find(c) for c in "/?#" if c in rest] or [len(rest)])
        host, rest = re.sub("[A-Z]", lambda m: m[0].lower(), rest[:end]), rest[end:]
        path = rest[: min([rest.find(c) for c in "?#" if c in rest] or [len(rest)])]
    rules = {("net", "/"): "block", ("example.net", "/en/"): "allow", ("example.com", "/de/"): "block", ("org", "/fr/"): "allow"}
    fit = [r for r in rules if (host == r[0] or host.endswith("." + r[0])) and path.startswith(r[1])]
    best = max(fit, key=lambda r: len(r[0] + r[1]), default=None)
    return host, path, best and best[0] + best[1], best and rules[best]


def test_verdicts(spark):
    rows = [(i, u, "x" * (5 if u and "thin" in u and i % 2 else 2000)) for i, u in enumerate(URLS)] + [(None, "http://a.b/c", None), (3, URLS[6], "x" * 2000), (3, URLS[6], "x" * 2000)]
    pages = clash(spark.createDataFrame(rows, "page_id long, url string, html string"))
    thin = {slow_verdict(u, None)[:2] for _, u, h in rows if len(h or "") < 1000}
    want = []
    for i, u, _ in rows:
        host, path, rule, action = slow_verdict(u, None)
        # a domain of at most 253 characters begins with a junk label, or the address is thin
        names = host.split(".")
        junk = any(len(".".join(names[k:])) <= 253 and names[k] in url_filters.JUNK_LABELS for k in range(max(0, len(names) - 254), len(names)))
        listed = host != "" and (junk or (host, path) in thin)
        want.append((i, host, path, rule, listed, action or ("block" if listed else "allow")))
    for filter_bytes in (url_filters.FILTER_BYTES, 16):
        got = url_filters.judge_urls(pages, url_filters.junk_keys(pages), filter_bytes=filter_bytes)
        assert sorted(map(tuple, got.collect()), key=str) == sorted(want, key=str)
    assert {r[-1] for r in want if r[3] is None} == {"allow", "block"}
    none = pages.where("false")
    assert url_filters.judge_urls(none, url_filters.junk_keys(pages)).count() == 0
    assert url_filters.judge_urls(pages, url_filters.junk_keys(none)).where("listed").count() == 0


@pytest.mark.parametrize("listed", [0, 1, 40, 3_000, 20_000])
def test_cascade_is_exact_for_all_its_keys(listed):
    rng = np.random.default_rng(listed)
    a, b = rng.integers(0, 1 << 64, (2, 20_000), dtype=np.uint64)
    flags = np.arange(20_000) < listed
    probes = url_filters.first_probes(listed, 20_000 - listed)
    levels = url_filters.cascade_of(a, b, flags, probes)
    shard = url_filters.Shard([(0, levels)], 1, 1, 0, probes)
    assert (shard.listed(a, b) == flags).all()
    assert len(levels) > 4 or listed in (0, 1, 20_000)
    # about 1.44 (log2(others / listed) + 0.5) + 4.2 bits for each listed key
    if listed in (40, 3_000):
        assert 8 * sum(map(len, levels)) < listed * (1.44 * (np.log2((20_000 - listed) / listed) + 1) + 4.2) + 200


def test_cascade_tells_keys_apart_that_share_one_hash():
    a = np.zeros(50, np.uint64)
    b = np.arange(50, dtype=np.uint64)
    flags = np.arange(50) % 2 == 0
    levels = url_filters.cascade_of(a, b, flags, 1)
    assert (url_filters.Shard([(0, levels)], 1, 1, 0, 1).listed(a, b) == flags).all()
    with pytest.raises(ValueError):
        url_filters.cascade_of(a, a, flags, 1)
