"""Secret scans with structural confirmation.

Three base patterns (assignments, access keys, long hex runs) give spans as they are. The method adds spans: runs that
look like base64 or hex are decoded, and only what parses is reported: DER key encodings whose nested lengths add up,
OpenSSH key blobs, PEM blocks around either or in base64 themselves, and signed tokens whose header is JSON naming an
algorithm. A key may follow any character but a letter or digit, and may be wrapped over lines of 16 characters or more.

Work is linear in a text's length: its runs and how they are wrapped are found once, a candidate's lengths and tags are read by place from
these, a few bytes each, and only a key that is right in all of them is taken; the search goes on behind it.

Null text: as empty. Empty text: no spans. An empty table: no rows. Very long texts are read whole. Equal rows give equal results, row by row; other columns are not looked at.
"""

from __future__ import annotations

import base64
import binascii
import hashlib
import json
import re
from bisect import bisect_left, bisect_right
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .common import as_batch, map_batches, read_table, texts_of

ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
#: A shorter run can hold no match, so this finds what [0-9a-f]+ with a check of the length finds.
HEX = re.compile(r"[0-9a-f]{24,}")
TOKEN = re.compile(r"(?<![A-Za-z0-9_-])(eyJ[A-Za-z0-9_-]+)\.([A-Za-z0-9_-]+)\.([A-Za-z0-9_-]*)(?![A-Za-z0-9_-])")
#: Where base64 of a DER sequence, of "openssh-key-v1" or of "-----BEGIN " (at each offset in its three bytes) begins; before
#: it neither letter nor digit, but for an escape.
BASE64 = re.compile(r"(?:(?<![A-Za-z0-9])|(?<=\\[nrt])|(?<=%[0-9A-Fa-f]{2}))(?:M[A-P]|b3BlbnNzaC1rZXktdjEA)")
PEM_BASE64 = re.compile("LS0tLS1CRUdJTi|0tLS0tQkVHSU4g|tLS0tLUJFR0lO")
#: What may stand for the rest of the three bytes that its first character is in, with the bits of the first dash.
PEM_HEAD = {"L": "", "0": "AC", "t": "AAA"}
#: Characters of base64 and hex, what lines are wrapped with, and what no key is followed by.
RUN, HEX_RUN, WRAP, AFTER = "A-Za-z0-9+/_-", "0-9A-Fa-f", re.compile(r"(?:\s|\\+[rn])+"), re.compile("[A-Za-z0-9=]")
LEAST, LINE = 40, 16
LONG_HEX = re.compile(r"(?<![0-9A-Fa-f])(?:[0-9A-Fa-f]{2}){20,}(?![0-9A-Fa-f])")
HEX_LINE = re.compile(r"(?<![0-9A-Fa-f])(?:30|6f70656e|6F70656E)[0-9A-Fa-f]{14,}(?=\s|\\+[rn])")
PEM_BEGIN = re.compile(r"-----BEGIN ((?:[A-Z0-9]+ )*PRIVATE KEY)-----")
KINDS = ("assign", "access", "hex", "token", "key_base64", "key_hex", "key_pem")
ORDER = {k: i for i, k in enumerate(KINDS)}


def base_spans(text: str) -> list[tuple[int, int, str]]:
    out = [(*m.span(), "assign") for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    out += [(*m.span(), "access") for m in ACCESS.finditer(text) if m.end() - m.start() >= 20]
    return out + [(*m.span(), "hex") for m in HEX.finditer(text)]


def unbase64(run: str) -> bytes | None:
    """Either alphabet, padded or not."""
    run = run.rstrip("=").replace("-", "+").replace("_", "/")
    try:
        return base64.b64decode(run + "=" * (-len(run) % 4), validate=True)
    except (binascii.Error, ValueError):
        return None


Reader = Callable[[int, int], bytes]


def der_item(read: Reader, at: int, end: int) -> tuple[int, int, int] | None:
    """(tag, start of the value, end of the value) of the DER item at `at`, if it fits before `end`."""
    head = read(at, 6)
    if at + 2 > end or len(head) < 2:
        return None
    tag, n, start = head[0], head[1], at + 2
    if n & 0x80:
        k = n & 0x7F
        if not 1 <= k <= 4 or start + k > end or len(head) < 2 + k:
            return None
        n, start = int.from_bytes(head[2 : 2 + k], "big"), start + k
        if n < 0x80:  # DER takes the shortest form
            return None
    return (tag, start, start + n) if start + n <= end else None


#: A key has ten items side by side at most; a sequence of more than this many is none.
MOST_ITEMS = 64


def der_children(read: Reader, at: int, end: int) -> list[tuple[int, int, int]] | None:
    """The items that fill [at, end) exactly."""
    out = []
    while at < end:
        if len(out) == MOST_ITEMS or not (item := der_item(read, at, end)):
            return None
        out.append(item)
        at = item[2]
    return out


OPENSSH = b"openssh-key-v1\0"


def openssh_fields(read: Reader, size: int) -> tuple[int, int] | None:
    """Where the number of keys of an OpenSSH blob is, and that number, if cipher, key derivation and its options fit before it."""
    at = len(OPENSSH)
    for _ in range(3):
        if at + 4 > size or (at := at + 4 + int.from_bytes(read(at, 4), "big")) > size:
            return None
    if at + 4 > size or not 1 <= (keys := int.from_bytes(read(at, 4), "big")) <= 64:
        return None
    return at, keys


def is_key(data: bytes) -> bool:
    return is_key_of(lambda at, n: data[at : at + n], len(data))


def is_key_of(read: Reader, size: int) -> bool:
    """A private key: PKCS#1, DSA, PKCS#8, SEC1 or an OpenSSH blob, with all nested lengths right. A few bytes are read for each length."""
    if read(0, len(OPENSSH)) == OPENSSH:
        return openssh_fields(read, size) is not None
    top = der_item(read, 0, size)
    if not top or top[0] != 0x30 or top[2] != size:
        return False
    parts = der_children(read, top[1], top[2])
    if not parts or parts[0][0] != 0x02 or len(parts) < 2:  # each kind begins with a version
        return False
    tags = [p[0] for p in parts]
    version = read(parts[0][1], min(2, parts[0][2] - parts[0][1]))
    if len(parts) >= 9 and set(tags[:9]) == {0x02}:  # PKCS#1: nine integers
        return True
    if len(parts) == 6 and set(tags) == {0x02}:  # DSA: version 0, p, q, g, y, x
        return version == b"\0"
    if len(parts) >= 3 and tags[1:3] == [0x30, 0x04]:  # PKCS#8: algorithm, then the key in an octet string
        algorithm = der_children(read, parts[1][1], parts[1][2])
        return bool(algorithm) and algorithm[0][0] == 0x06 and parts[2][2] > parts[2][1]
    return tags[1] == 0x04 and version == b"\x01" and 16 <= parts[1][2] - parts[1][1] <= 80  # SEC1


def is_signed_token(header: str, payload: str) -> bool:
    """A token whose decoded header names its algorithm and whose payload is a JSON object."""
    for part, key in ((header, "alg"), (payload, None)):
        try:
            found = json.loads(unbase64(part) or b"")
        except (ValueError, RecursionError):
            return False
        if not isinstance(found, dict) or key and not isinstance(found.get(key), str):
            return False
    return True


class Runs:
    """The runs of a text's characters of one kind, read over wrapped lines by place: a run of 16 characters or more goes on behind its wrap."""

    def __init__(self, text: str, characters: str):
        self.text, self.starts, self.ends = text, [], []
        #: Of each run: characters of all runs before it, and the place in these where what goes on from it ends.
        self.before, self.through = [], []
        linked, wrapped, total = [], None, 0
        for m in re.finditer(rf"((?:\s|\\+[rn])+)|[{characters}]+", text):
            if m[1]:
                wrapped = m.span()
                continue
            start, end = m.span()
            linked.append(bool(self.ends) and wrapped == (self.ends[-1], start) and end > start and self.ends[-1] - self.starts[-1] >= LINE)
            self.starts.append(start)
            self.ends.append(end)
            self.before.append(total)
            total += end - start
        self.linked = linked
        self.through = [b + e - s for b, e, s in zip(self.before, self.ends, self.starts, strict=True)]
        for i in range(len(linked) - 1, 0, -1):
            if linked[i]:
                self.through[i - 1] = self.through[i]

    def run_end(self, at: int) -> int:
        return self.ends[bisect_right(self.starts, at) - 1]

    def left(self, at: int) -> int:
        """How many characters there are from `at` on."""
        i = bisect_right(self.starts, at) - 1
        here = self.ends[i] - at
        return here if here < LINE else self.through[i] - self.before[i] - (at - self.starts[i])

    def place(self, at: int, k: int) -> int:
        """Where the first k characters from `at` on end."""
        i = bisect_right(self.starts, at) - 1
        count = self.before[i] + (at - self.starts[i]) + k
        j = max(i, bisect_left(self.before, count) - 1)
        return self.starts[j] + count - self.before[j]

    def slice(self, at: int, skip: int, n: int) -> str:
        """n characters, or all that are left, from the one on that is `skip` behind `at`."""
        n = min(n, self.left(at) - skip)
        out = []
        while n > 0:
            place = self.place(at, skip + 1) - 1
            out.append(self.text[place : min(place + n, self.run_end(place))])
            skip, n = skip + len(out[-1]), n - len(out[-1])
        return "".join(out)

    def base64_reader(self, at: int) -> Reader:
        def read(start: int, n: int) -> bytes:
            skip = start // 3 * 4
            piece = self.slice(at, skip, -(-(start % 3 + n) * 4 // 3))
            data = unbase64(piece[: len(piece) - (len(piece) % 4 == 1)]) or b""
            return data[start % 3 : start % 3 + n]

        return read

    def hex_reader(self, at: int) -> Reader:
        def read(start: int, n: int) -> bytes:
            piece = self.slice(at, 2 * start, 2 * n)
            return bytes.fromhex(piece[: len(piece) // 2 * 2])

        return read


def der_size(head: bytes) -> int | None:
    """Bytes of the DER sequence whose first item is an integer, by its first bytes."""
    k = head[1] & 0x7F if len(head) > 1 and head[1] & 0x80 else 0
    if len(head) < 3 + k or head[0] != 0x30 or k > 4 or head[2 + k] != 0x02:
        return None
    return 2 + k + (int.from_bytes(head[2 : 2 + k], "big") if k else head[1])


def openssh_size(read: Reader, size: int) -> int | None:
    """Bytes of the OpenSSH blob at the beginning of `size` bytes, by its fields: cipher, key derivation, options, public keys, private part."""
    if not (found := openssh_fields(read, size)):
        return None
    at, keys = found
    at += 4
    for _ in range(keys + 1):
        if at + 4 > size:
            return None
        at += 4 + int.from_bytes(read(at, 4), "big")
    return at if at <= size else None


def base64_end(text: str, at: int, runs: Runs) -> int | None:
    """Where the base64 of the key that begins at `at` ends."""
    read, left = runs.base64_reader(at), runs.left(at)
    if text[at] == "M":
        if not (size := der_size(unbase64(text[at : at + 12]) or b"")):
            return None
        need = (size * 4 + 2) // 3
    else:
        there = (left - (left % 4 == 1)) * 3 // 4
        if not openssh_fields(read, there):
            return None
        size = openssh_size(read, there)
        need = left if size is None else (size * 4 + 2) // 3
        size = there if size is None else size
    if need < LEAST or need > left or need % 4 == 1:
        return None
    end = found = runs.place(at, need)
    while text.startswith("=", end) and end < found + 2:
        end += 1
    if AFTER.match(text, end) or not is_key_of(read, size):
        return None
    return end


def pem_spans(text: str) -> list[tuple[int, int]]:
    begins, out = list(PEM_BEGIN.finditer(text)) if "-----BEGIN " in text else [], []
    for m, after in zip(begins, [*begins[1:], None], strict=False):
        limit = after.start() if after else len(text)
        end = text.find(tail := f"-----END {m[1]}-----", m.end(), limit)
        if end >= 0:
            lines = re.sub(r"\\+[rn]", "\n", text[m.end() : end])
            body = re.sub(r"\s+", "", re.sub(r"(?m)^[ \t]*[A-Za-z-]+: .*$", "", lines))
            ciphertext = m[1].startswith("ENCRYPTED"), re.search(r"(?m)^[ \t]*Proc-Type: *4, *ENCRYPTED\s+DEK-Info: *[A-Za-z0-9-]+, *[0-9A-Fa-f]{16,}\s*$", lines)
            if (data := unbase64(body)) and (is_key(data) or ciphertext[0] and der_item(lambda at, n: data[at : at + n], 0, len(data)) or ciphertext[1] and len(data) >= 16 and len(data) % 8 == 0):
                out.append((m.start(), end + len(tail)))
    return out


def packed_pems(text: str, runs: Runs) -> list[tuple[int, int]]:
    """Spans of base64 of PEM blocks."""
    out, done = [], 0
    for m in PEM_BASE64.finditer(text):
        if m.start() < done:
            continue
        head, left = PEM_HEAD[m[0][0]], runs.left(m.start())
        run, done = runs.slice(m.start(), 0, left), runs.place(m.start(), left)
        packed = head + run
        found = pem_spans((unbase64(packed[: len(packed) - (len(packed) % 4 == 1)]) or b"").decode("latin-1"))
        if found:
            end = runs.place(m.start(), min((found[-1][1] * 4 + 2) // 3 - len(head), len(run)))
            # the rest of its run, as line ends after the last mark, belongs to it
            end = max(end, runs.run_end(end - 1))
            while text.startswith("=", end):
                end += 1
            out.append((m.start(), end))
    return out


def confirmed_spans(text: str) -> list[tuple[int, int, str]]:
    """Spans of decoded and parsed keys and tokens. Lines after a PEM begin are not also a wrapped key; they need their end mark."""
    out = []
    if "eyJ" in text:
        out += [(*m.span(), "token") for m in TOKEN.finditer(text) if is_signed_token(m[1], m[2])]
    pems, done = pem_spans(text), 0
    begun = [m.end() for m in PEM_BEGIN.finditer(text)] if "-----BEGIN " in text else []
    opened = {wrap.end() if (wrap := WRAP.match(text, end)) else end for end in begun}
    out += [(*span, "key_pem") for span in pems]
    runs = Runs(text, RUN) if BASE64.search(text) or PEM_BASE64.search(text) else None
    if runs:
        out += [(*span, "key_base64") for span in packed_pems(text, runs)]
    at = 0
    while runs and (m := BASE64.search(text, at)):
        at = m.start() + 1
        if end := base64_end(text, m.start(), runs):
            at = end
            before = bisect_right(pems, (m.start(), len(text))) - 1
            if runs.run_end(m.start()) + 2 >= end or not (m.start() in opened or before >= 0 and m.start() < pems[before][1]):
                out.append((m.start(), end, "key_base64"))
    for m in LONG_HEX.finditer(text):
        if is_key(bytes.fromhex(m[0])):
            out.append((*m.span(), "key_hex"))
    done, runs = 0, None
    for m in HEX_LINE.finditer(text):
        if m.start() < done:
            continue
        runs = runs or Runs(text, HEX_RUN)
        read, left = runs.hex_reader(m.start()), runs.left(m.start())
        size = der_size(bytes.fromhex(m[0][:16])) if m[0].startswith("30") else openssh_size(read, left // 2)
        if size and len(m[0]) < 2 * size <= left and (end := runs.place(m.start(), 2 * size)) == runs.run_end(end - 1) and is_key_of(read, size):
            done = end
            out.append((m.start(), done, "key_hex"))
    return out


def joined(spans: list[tuple[int, int, str]]) -> str:
    return ",".join(f"{kind}:{a}:{b}" for a, b, kind in sorted(spans, key=lambda s: (s[0], ORDER[s[2]], s[1])))


def scan_text(text: str) -> tuple[list, list]:
    return base_spans(text), confirmed_spans(text)


def scan_secrets(docs: DataFrame) -> DataFrame:
    """doc_id and the array of spans (kind, start, end) of each row of docs, in one pass without a shuffle."""
    span = "array<struct<kind: string, start: long, end: long>>"
    id_type = docs.schema["doc_id"].dataType.simpleString()

    def make():
        kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))

        def run(batch: pa.RecordBatch) -> pa.RecordBatch:
            rows = []
            for text in texts_of(batch.column(1)):
                base, more = scan_text(text)
                rows.append([{"kind": k, "start": a, "end": b} for a, b, k in sorted(base + more, key=lambda s: (s[0], ORDER[s[2]], s[1]))])
            return pa.RecordBatch.from_arrays([batch.column(0), pa.array(rows, kind)], names=["doc_id", "found"])

        return run

    return map_batches(docs.select("doc_id", "text"), make, f"doc_id {id_type}, found {span}")


def op1_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The spans of scan_secrets as counts and digests, one row for each document."""
    base = KINDS[:3]

    def make():
        schema = pa.schema([("doc_id", pa.int64()), ("n_assign", pa.int64()), ("n_access", pa.int64()), ("n_hex", pa.int64()), ("n_confirmed", pa.int64()), ("base_sha256", pa.string()), ("spans", pa.string())])

        def run(batch: pa.RecordBatch) -> pa.RecordBatch:
            out = []
            for doc_id, found in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                spans = [(s["start"], s["end"], s["kind"]) for s in found]
                n = [sum(s[2] == k for s in spans) for k in base]
                digest = hashlib.sha256(joined([s for s in spans if s[2] in base]).encode()).hexdigest()
                out.append((doc_id, *n, len(spans) - sum(n), digest, joined(spans)))
            return as_batch(zip(*out, strict=True), schema)

        return run

    return map_batches(scan_secrets(read_table(spark, sf_dir, "documents")), make, "doc_id long, n_assign long, n_access long, n_hex long, n_confirmed long, base_sha256 string, spans string")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {"op1_secret_scan": op1_secret_scan}
SQL: dict[str, str] = {}
