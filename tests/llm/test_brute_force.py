"""Registered queries that SQL cannot express, against brute force on a whole given table."""

import collections
import datetime
import hashlib
import math
import os
import re
import zlib

import numpy as np
import pyarrow.parquet as pq
import pytest

from brindle.llm import license_scan, pii, queries

SF = "/root/testdata/sf0.01"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
WORD = re.compile(r"[^\x20\x09-\x0D]+")


@pytest.fixture(scope="module")
def documents():
    return pq.read_table(f"{SF}/documents.parquet", columns=["doc_id", "source", "text"]).to_pylist()


def result(spark, name, *columns):
    return [tuple(r) for r in queries.queries()[name](spark, SF).select(*columns).collect()]


def test_token_files(spark, documents):
    public = pytest.importorskip("public_tokenizers")
    from tokenizers import Tokenizer

    encoder, start, want = Tokenizer.from_file(public.path("byte_bpe_50k.json")), 0, []
    for d in sorted(documents, key=lambda d: d["doc_id"]):
        ids = encoder.encode(d["text"] or "", add_special_tokens=False).ids + [0]
        want.append((d["doc_id"], start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    assert sorted(result(spark, "op3_token_files", "doc_id", "start", "n_tokens", "ids_crc32")) == want


def test_suffix_dedup(spark, documents, n=400):
    raw = [(d["doc_id"], (d["text"] or "").encode()) for d in documents]
    times = collections.Counter(hash(b[i : i + n]) for _, b in raw for i in range(len(b) - n + 1))
    want = []
    for d, b in raw:
        gone = np.zeros(len(b) + 1, int)
        for i in range(len(b) - n + 1):
            if times[hash(b[i : i + n])] > 1:
                gone[i] += 1
                gone[i + n] -= 1
        mask = np.cumsum(gone)[:-1] > 0
        runs = int((np.diff(np.append(0, mask.astype(int))) == 1).sum())
        want.append((d, len(b), int(mask.sum()), runs, hashlib.sha256(bytes(np.frombuffer(b, np.uint8)[~mask])).hexdigest()))
    assert sorted(result(spark, "op7_suffix_dedup", "doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")) == sorted(want)


def test_mixing(spark, documents):
    size = {d["doc_id"]: len(WORD.findall(d["text"] or "")) for d in documents}
    source = {d["doc_id"]: d["source"] for d in documents}
    total = collections.Counter()
    for d in documents:
        total[d["source"]] += size[d["doc_id"]]
    names = sorted(total, key=lambda s: (s is None, s or ""))
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}
    target, left, free = {}, 1.5 * sum(total.values()), set(names)
    while free:  # sources over twice their size stop there, the rest share again
        share = {s: left * weight[s] / sum(weight[t] for t in free) for s in free}
        full = {s for s in free if share[s] > 2 * total[s]} or None
        if full is None:
            target |= share
            break
        for s in full:
            target[s] = 2.0 * total[s]
            left -= target[s]
        free -= full
    got = result(spark, "op9_mixing", "doc_id", "size", "source_size", "target", "taken")
    assert sorted(r[0] for r in got) == sorted(size)
    taken = collections.Counter()
    for d, n, of_source, goal, words in got:
        assert (n, of_source) == (size[d], total[source[d]])
        assert goal == pytest.approx(target[source[d]])
        assert 0 <= words <= 2 * n
        taken[source[d]] += words
    for s in names:
        largest = max(size[d] for d in size if source[d] == s)
        assert abs(taken[s] - target[s]) <= largest
    assert sorted(result(spark, "op9_mixing", "doc_id", "size", "source_size", "target", "taken")) == sorted(got)


def test_mixing_draw(spark, documents):
    """Keys from md5 and quality, in order, until the budget: the very documents that the query takes."""
    got = {r[0]: r[1:] for r in result(spark, "op9_mixing", "doc_id", "size", "source_size", "target", "taken")}
    by_source = collections.defaultdict(list)
    for d in documents:
        text = d["text"] or ""
        u = (int(hashlib.md5(f"{d['doc_id']}:17".encode()).hexdigest()[:13], 16) + 0.5) / 2**52
        quality = max(0.1, 1 - 4 * len(re.findall(r"[#*$%&|<>]", text)) / max(len(text), 1))
        by_source[d["source"]].append((-math.log(u) / quality, d["doc_id"]))
    for drawn in by_source.values():
        _, whole, target, _ = got[drawn[0][1]]
        epochs = math.floor(target / whole)
        budget, upto = target - epochs * whole, 0
        for _, d in sorted(drawn):
            size = got[d][0]
            upto += size
            once = upto - budget <= budget - (upto - size)
            assert got[d][3] == size * (epochs + once)


class Feistel:
    """The pseudonyms once more, in plain Python."""

    def __init__(self, key):
        self.key = key

    def digest(self, *parts):
        return hashlib.sha256("|".join([self.key, *map(str, parts)]).encode()).hexdigest()

    def text(self, v, kind, hexadecimal=False):
        halves = [v[: len(v) // 2], v[len(v) // 2 :]]
        for t in range(8):
            d = self.digest(kind, t, len(v), halves[1 - t % 2].lower())
            halves[t % 2] = "".join(self.shift(c, int(d[i % 32 * 2 :][:2], 16), hexadecimal) for i, c in enumerate(halves[t % 2]))
        return "".join(halves)

    @staticmethod
    def shift(c, by, hexadecimal):
        if hexadecimal:
            new = "0123456789abcdef"[(int(c, 16) + by) % 16]
            return new.upper() if c.lower() != c else new
        for letters in ("0123456789", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"):
            if c in letters:
                return letters[(letters.index(c) + by) % len(letters)]
        return c

    def number(self, n, left, right, kind):
        x, y = divmod(n, right)
        for t in range(8):
            if t % 2 == 0:
                x = (x + int(self.digest(kind, t, y)[:15], 16)) % left
            else:
                y = (y + int(self.digest(kind, t, x)[:15], 16)) % right
        return x * right + y


def luhn(d):
    return sum(int(c) if k % 2 == 0 else 2 * int(c) - 9 * (c > "4") for k, c in enumerate(d[::-1]))


def pseudonym(f, kind, m):
    bare = re.sub("[^0-9A-Za-z]", "", m)
    if kind == "email":
        lead = re.match("[._%+-]*", m).group()
        name, _, host = m[len(lead) :].partition("@")
        return lead + f.text(name, kind) + "@" + host
    if kind == "secret":
        value = re.search("[A-Za-z0-9_+/-]+(?=.$)", m).group()
        new = f.text(value, kind, bool(re.fullmatch("[0-9a-f]+|[0-9A-F]+", value)))
        return m[: -len(value) - 1] + new + m[-1]
    if kind == "ip":
        octets = [int(x) for x in m.split(".")]
        if max(octets) > 255:
            return None
        n = f.number(int.from_bytes(bytes(octets), "big"), 65536, 65536, kind)
        return ".".join(map(str, n.to_bytes(4, "big")))
    if kind == "date":
        form = "%Y-%m-%d" if m[4] == "-" else "%d/%m/%Y" if "/" in m else "%d.%m.%Y"
        try:
            day = (datetime.datetime.strptime(m, form).date() - datetime.date(1000, 1, 1)).days
        except ValueError:
            return None
        moved = day - day % 146097 + f.number(day % 146097, 189, 773, kind)
        return (datetime.date(1000, 1, 1) + datetime.timedelta(moved)).strftime(form)
    if kind == "ssn":
        a, g, s = int(m[:3]), int(m[4:6]), int(m[7:])
        if not (0 < a < 900 and a != 666 and g and s):
            return None
        n = f.number((((a - 2 if a > 666 else a - 1) * 99 + g - 1) * 9999 + s - 1), 898 * 99, 9999, kind)
        a = n // (99 * 9999) + 1
        return f"{a + (a >= 666):03d}-{n // 9999 % 99 + 1:02d}-{n % 9999 + 1:04d}"
    if kind == "phone":
        if not 8 <= len(bare) <= 15:
            return None
        code = re.match(r"\+([0-9]{1,3})", m).group(1)
        new = code + f.text(bare[len(code) :], kind)
    elif kind == "local_phone":
        new = bare[0] + f.text(bare[1:], kind)
    elif kind == "card":
        if not re.fullmatch(pii._ISSUERS, bare) or luhn(bare) % 10:
            return None
        new = bare[:4] + f.text(bare[4:-1], kind)
        new += str(-luhn(new + "0") % 10)
    else:
        raise AssertionError(f"{kind}: not in the given tables")
    letters = iter(new)
    return re.sub("[0-9A-Za-z]", lambda _: next(letters), m)


def test_pii(spark, documents):
    regex = pytest.importorskip("regex")
    patterns = {k: regex.compile(p) for k, p in pii.PATTERNS.items()}
    anything = regex.compile(pii._ANY)
    f, want = Feistel(queries.SHOWN_KEY), []
    for d in documents:
        kinds = []

        def replaced(m):
            kind = next(k for k, p in patterns.items() if (x := p.match(m.string, m.start())) and x.end() == m.end())
            new = pseudonym(f, kind, m.group())
            if new is None:
                return m.group()
            kinds.append(kind)  # noqa: B023
            return new

        text = d["text"] and anything.sub(replaced, d["text"])
        want.append((d["doc_id"], text, len(kinds), ",".join(sorted(set(kinds)))))
    got = result(spark, "op1_pii", "doc_id", "text", "n_found", "kinds")
    assert len({k for r in want for k in r[3].split(",")}) > 3
    assert sorted(got) == sorted(want)


def test_license_scan(spark, documents):
    """Every text read without the search for licence words and without Spark."""
    own = license_scan.model()
    want = []
    for d in documents:
        found = license_scan.notices(own, d["text"] or "", 0.6, 0.6)
        want.append((d["doc_id"], len(found), ",".join(sorted({x["family"] for x in found if x["confirmed"]})), max((x["probability"] for x in found), default=None)))
    assert sorted(result(spark, "op4_license_scan", "doc_id", "n_found", "families", "best_probability")) == sorted(want)


def test_quality_fences_follow_their_groups(spark):
    """On sf0.1 every language and source has documents enough for quartiles of its own, and fences of its own."""
    from brindle.llm import quality_rules

    large = SF.replace("0.01", "0.1")
    if not os.path.isdir(large):
        pytest.skip("no test tables")
    docs = spark.read.parquet(f"{large}/documents.parquet")
    measured = quality_rules.measures(docs, carry=("doc_id", "lang", "source")).cache()
    fences = quality_rules.thresholds(quality_rules.sketches(measured)).toPandas()
    values = measured.filter("NOT base_failed").toPandas()
    measured.unpersist()
    groups = values.groupby(["lang", "source"])
    assert groups.size().min() >= 20 and len(fences) == len(groups)
    for name in ("q_symbols_most", "q_repeat_words_most", "q_word_length_most"):
        assert fences[name].nunique() > 10
    # The sketch's quartiles lie within a bin of the real ones.
    for lang_source, own in list(groups)[::7]:
        fence = fences[(fences.lang == lang_source[0]) & (fences.source == lang_source[1])].iloc[0]
        mid = sorted(own.q_word_length)[(len(own) + 1) // 2 - 1]
        assert 0 <= mid - (fence.q_word_length_most + fence.q_word_length_least) / 2 <= mid / 64
