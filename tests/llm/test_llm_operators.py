"""Each operator against a brute-force version on documents with nulls, empties, long texts, ties, repeats and clashing columns."""

from __future__ import annotations

import base64
import gzip
import hashlib
import random
import re
import time
import urllib.parse
import zlib
from collections import Counter

import numpy as np
import pytest
import zstandard
from fixtures import rows, save, table

from threadloom.llm import decontaminate, fingerprints, language_id, mixing, near_dedup, paragraphs, pii, repeats, secrets, toxicity

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


@pytest.fixture(scope="module")
def docs(spark):
    return table(spark).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return table(spark, [])


class Union:
    def __init__(self, items):
        self.up = {i: i for i in items}

    def find(self, x):
        while self.up[x] != x:
            x = self.up[x]
        return x

    def join(self, a, b):
        a, b = self.find(a), self.find(b)
        self.up[max(a, b)] = min(a, b)


def test_near_duplicates(docs):
    found = near_dedup.near_duplicates(docs).collect()
    assert len(found) == docs.count()
    sets = {}
    for r in rows():
        w = WORD.findall((r[1] or "").translate(LOWER))
        sets[r[0]] = frozenset(tuple(w[k : k + 5]) for k in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])
    known = [i for i in sets if i is not None]
    u = Union(known)
    for i in known:
        for j in known:
            both = len(sets[i] & sets[j])
            if i < j and both and 100 * both >= 70 * len(sets[i] | sets[j]):
                u.join(i, j)
    for r in found:
        if r.doc_id is None:
            assert r.component_id is None and r.kept
        else:
            assert (r.n_shingles, r.component_id, r.kept) == (len(sets[r.doc_id]), u.find(r.doc_id), u.find(r.doc_id) == r.doc_id)


def test_near_duplicates_of_a_large_group(spark):
    """A group of near copies that all differ, and documents that share a passage without being near: components stay exact."""
    from fixtures import words

    rng = random.Random(8)
    base = words(rng, 60).split()
    made = []
    for k in range(300):
        w = list(base)
        w[rng.randrange(60)] = f"new{k}"
        made.append((k, " ".join(w)))
    shared = words(rng, 40)
    made += [(1000 + k, shared + " " + words(rng, 60)) for k in range(300)]
    got = {r.doc_id: r.component_id for r in near_dedup.near_duplicates(spark.createDataFrame(made, "doc_id long, text string")).collect()}
    assert {got[k] for k in range(300)} == {0}
    assert all(got[1000 + k] == 1000 + k for k in range(300))


def test_near_dedup_keeps_one_of_each_group(docs):
    kept = near_dedup.without_near_duplicates(docs)
    assert kept.columns == docs.columns
    ids = Counter(r.doc_id for r in kept.select("doc_id").collect())
    want = {r.doc_id for r in near_dedup.near_duplicates(docs).collect() if r.kept and r.doc_id is not None}
    assert {i for i in ids if i is not None} == want and all(n == 1 for i, n in ids.items() if i is not None) and ids[None] == 2


def test_repeated_substrings(docs):
    found = repeats.repeated_substrings(docs).collect()
    assert len(found) == docs.count()
    least: dict[bytes, int] = {}
    last = (1 << 63) - 1
    made = [(r[0] if r[0] is not None else last, (r[1] or "").encode()) for r in rows()]
    for i, b in made:
        for k in range(len(b) - 49):
            g = b[k : k + 50]
            least[g] = min(least.get(g, last), i)
    want = Counter()
    for i, b in made:
        gone = bytearray(len(b))
        for k in range(len(b) - 49):
            if least[b[k : k + 50]] < i:
                gone[k : k + 50] = b"\1" * 50
        spans = sum(1 for k, x in enumerate(gone) if x and (k == 0 or not gone[k - 1]))
        want[(i, len(b), sum(gone), spans, hashlib.sha256(bytes(x for x, y in zip(b, gone) if not y)).hexdigest())] += 1
    assert Counter((r.doc_id if r.doc_id is not None else last, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in found) == want
    assert any(r.n_removed for r in found)


def test_refined_buckets_equal_brute_force():
    rng = random.Random(1)
    for t in range(120):
        alphabet = b"ab" if t % 2 else b"abcdefgh"
        pool = [bytes(rng.choice(alphabet) for _ in range(rng.randrange(50, 140))) for _ in range(4)]
        made = []
        for _ in range(rng.randrange(1, 12)):
            x = rng.choice(pool)
            lo = rng.randrange(len(x) - 49)
            y = x[lo : rng.randrange(lo + 50, len(x) + 1)] * rng.choice((1, 1, 2))
            made.append((b"a" * rng.randrange(50, 90) if rng.random() < 0.2 else y, rng.randrange(5)))
        least = {}
        for y, o in made:
            for k in range(len(y) - 49):
                least[y[k : k + 50]] = min(least.get(y[k : k + 50], 9), o)
        want = [len(y) - k >= 50 and least[y[k : k + 50]] < o for y, o in made for k in range(len(y))]
        got = repeats.repeated_windows(np.frombuffer(b"".join(y for y, _ in made), np.uint8), np.array([len(y) for y, _ in made]), np.array([o for _, o in made]))
        assert got.tolist() == want


def test_runs_of_equal_hash_and_unequal_bytes_stand_alone(monkeypatch):
    import pyarrow as pa

    monkeypatch.setattr(repeats, "BYTE_CODE", np.zeros(256, np.uint64))  # strings of one length collide
    texts = ["x" * 60 + "y" * 60, "x" * 60 + "z" * 60, "x" * 60 + "y" * 60]
    s = repeats.Segment(pa.table({"doc_id": pa.array([1, 2, 3]), "text": pa.array(texts)}))
    s.strings(np.ones(len(s.start), bool))
    for run, of in zip(s.run, s.of):
        head = s.first[of]
        n = s.count[run] + repeats.LENGTH - 1
        assert s.count[head] == s.count[run] and (s.data[s.start[run] : s.start[run] + n] == s.data[s.start[head] : s.start[head] + n]).all()


def test_repeated_paragraphs(docs):
    found = paragraphs.repeated_paragraphs(docs).collect()
    assert len(found) == docs.count()
    text = {r[0]: r[1] or "" for r in rows()}
    for r in found:
        spans = [tuple(map(int, s.split(":"))) for s in r.removed.split(",") if s]
        b, out, at = text[r.doc_id].encode(), b"", 0
        for lo, hi in spans:
            out, at = out + b[at:lo], hi
        assert hashlib.sha256(out + b[at:]).hexdigest() == r.kept_sha256 and len(spans) == r.n_removed
    by = {r.doc_id: r for r in found}
    assert by[0].n_removed == 0 and by[47].n_removed == by[47].n_paragraphs > 0  # an exact copy loses every paragraph
    assert by[40].n_paragraphs == 0 and by[41].n_paragraphs == 0


def test_repeated_paragraphs_of_short_sentences(spark):
    """A 50-word passage of sentences of 4 to 7 words, pasted mid-line, and short lines that other documents have too."""
    from fixtures import words

    rng = random.Random(12)
    sentences = [words(rng, n) + "." for n in (5, 4, 7, 6, 4, 5, 7, 4, 5, 3)]
    passage = " ".join(sentences)
    made = [(k, f"{words(rng, 30 + k)} {passage} {words(rng, 25 + k)}") for k in range(5)]
    made += [(10 + k, f"{words(rng, 12)}\nAll rights reserved.\n{words(rng, 11)}") for k in range(3)] + [(20, "Two words"), (21, "two  words"), (22, "Two other words. And more")]
    text = dict(made)
    r = {x.doc_id: x for x in paragraphs.repeated_paragraphs(spark.createDataFrame(made, "doc_id long, text string")).collect()}
    gone = {i: " ".join(text[i][int(a) : int(b)] for a, b in (s.split(":") for s in x.removed.split(",") if s)) for i, x in r.items()}
    assert gone[0] == "" and all(gone[k].split() == " ".join(sentences[1:]).split() for k in range(1, 5))  # the first sentence runs on from the text before it
    assert [gone[k] for k in (10, 11, 12, 20, 21, 22)] == ["", "All rights reserved.", "All rights reserved.", "", "two  words", ""]


def test_removed_paragraphs_equal_brute_force(spark):
    """Near and exact copies of paragraphs among texts that share none: every link that all pairs show is found."""
    import pyarrow as pa

    rng = random.Random(31)
    pool = [f"w{k}" for k in range(900)]
    base = [[rng.choice(pool) for _ in range(rng.randrange(9, 50))] for _ in range(60)]
    made = []
    for k in range(150):
        lines = []
        for _ in range(rng.randrange(1, 6)):
            line = list(rng.choice(base)) if rng.random() < 0.6 else [rng.choice(pool) for _ in range(rng.randrange(9, 40))]
            for _ in range(rng.choice((0, 0, 1, 2))):
                line[rng.randrange(len(line))] = rng.choice(pool)
            lines.append(" ".join(line))
        made.append((k, "\n".join(lines)))
    p = paragraphs.Paragraphs(pa.table({"doc_id": pa.array([k for k, _ in made]), "text": pa.array([t for _, t in made])}))
    sets = [frozenset(part[part >> np.uint64(52) == d].tolist()) for part in p.keys for d in np.unique(part >> np.uint64(52))]
    sets = [frozenset(x & ((1 << 52) - 1) for x in s) for s in sets]
    u = Union(range(len(sets)))
    for i in range(len(sets)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and 100 * both >= 70 * len(sets[i] | sets[j]):
                u.join(i, j)
    owner = {}
    for i, at in enumerate(p.long):
        owner[u.find(i)] = min(owner.get(u.find(i), 1 << 60), int(p.row[at]))
    want = {(int(p.row[at]), int(p.start[at] - p.bounds[p.row[at]])) for i, at in enumerate(p.long) if owner[u.find(i)] < p.row[at]}
    long = {(int(p.row[at]), int(p.start[at] - p.bounds[p.row[at]])) for at in p.long}
    got = set()
    for r in paragraphs.repeated_paragraphs(spark.createDataFrame(made, "doc_id long, text string")).collect():
        got |= {(r.doc_id, int(x.split(":")[0])) for x in r.removed.split(",") if x}
    assert len(want) > 100 and len(want - got) <= 0.01 * len(want) and not (got & long) - want


def test_boilerplate_paragraphs_make_no_rows_of_pairs(spark, monkeypatch):
    """Paragraphs that share half their words meet in the same buckets; what is staged stays in proportion to them, and those that link are found."""
    from threadloom.llm import components, lsh

    opening = "each copy of this notice was sent by the northern office under the old rules and names one case"
    unique = [" ".join(f"w{k}x{j}" for j in range(8)) for k in range(600)]
    rows = [(k, f"{opening} {unique[k]}.") for k in range(600)] + [(1000 + k, f"{opening} {unique[k]} again.") for k in range(0, 600, 50)]
    docs, staged, old = spark.createDataFrame(rows, "doc_id long, text string"), [], lsh.stage

    def counted(df, name):
        out = old(df, name)
        staged.append((out.count(), name))
        return out

    for module in (lsh, components, paragraphs):
        monkeypatch.setattr(module, "stage", counted)
    found = {r.doc_id: r for r in paragraphs.repeated_paragraphs(docs).collect()}
    assert max(staged)[0] <= paragraphs.BANDING.bands * len(rows), staged
    whole = {k for k in range(1, 600) if found[k].n_paragraphs == 2}  # cut after "was", which all share up to there, and in some after other words
    assert len(found) == len(rows) and len(whole) > 400 and all(found[k].n_removed == 1 for k in whole)
    copies = [k for k in found if k - 1000 in whole]
    assert len(copies) > 6 and all(found[k].n_removed == 2 for k in copies)
    monkeypatch.setattr(lsh, "CELL", 64)  # great buckets are compared block against block
    assert {r.doc_id: r for r in paragraphs.repeated_paragraphs(docs).collect()} == found


def test_joined_buckets_equal_brute_force():
    from threadloom.llm import lsh

    rng = np.random.default_rng(8)
    for _ in range(40):
        base = rng.integers(0, 40, (3, 14))
        sets = []
        for k in range(50):
            words = base[rng.integers(0, 3)].copy()
            other = rng.random(14) < rng.random() * 0.4
            words[other] = rng.integers(0, 200, other.sum())
            sets.append(np.unique(words[: rng.integers(3, 15)]))
        cell = np.repeat([0, 1], [20, 30])
        label, _ = lsh.prefix_components(cell, np.repeat(np.arange(50), [len(s) for s in sets]), np.concatenate(sets).astype(np.uint64), paragraphs.BANDING)
        want = np.arange(50)
        for a in range(50):
            for b in range(a):
                x, y = set(sets[a].tolist()), set(sets[b].tolist())
                if cell[a] == cell[b] and 100 * len(x & y) >= 70 * len(x | y):
                    want[want == max(want[a], want[b])] = min(want[a], want[b])
        assert label.tolist() == want.tolist()


def test_fingerprints(docs):
    found = fingerprints.fingerprints(docs.filter("doc_id is not null").dropDuplicates(["doc_id"])).collect()
    text = {r[0]: r[1] or "" for r in rows() if r[0] is not None}
    order = sorted(text, reverse=True)
    after = dict(zip(order, [*order[1:], order[0]]))
    prints = {}
    for r in found:
        t, n = text[r.doc_id], text[after[r.doc_id]]
        edited = t[: len(t) - len(t) // 2] + n[: len(t) // 2]
        assert r.n_chars == len(t) and r.edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        a, b, c = (set(fingerprints.digests([x])[1].tolist()) for x in (t, edited, n))
        like = lambda x, y: len(x & y) / len(x | y) if x | y else 1.0
        assert abs(r.near_edited - like(a, b)) < 1e-12 and abs(r.near_next - like(a, c)) < 1e-12
        assert prints.setdefault(t, r.fingerprint) == r.fingerprint
    assert len(found) == len(text)


def test_fingerprints_of_repeats_nulls_and_one_row(spark, docs):
    assert len(fingerprints.fingerprints(docs).collect()) == docs.count()
    one = fingerprints.fingerprints(spark.createDataFrame([(7, "a b c")], "doc_id long, text string")).collect()
    assert len(one) == 1 and one[0].near_next == 1.0


def test_peeling_retries_until_it_succeeds():
    rng = np.random.default_rng(1)
    for n in (1, 30, 500, 5000):
        a = rng.integers(0, 1 << 63, n, dtype=np.int64).astype(np.uint64)
        b = rng.integers(0, 1 << 63, n // 2, dtype=np.int64).astype(np.uint64)
        assert fingerprints.differences((np.zeros(n, int), a), (np.zeros(n // 2, int), b), 1)[0] == n + n // 2


def test_mixing(docs):
    found = mixing.mix_sources(docs).collect()
    assert len(found) == docs.count()
    size = Counter()
    for r in rows():
        size[r[3]] += len(WORD.findall(r[1] or ""))
    names = sorted((s for s in size if s is not None)) + [None]
    weight = dict(zip(names, [5.0, 2.0, 1.0, 5.0]))
    total, capped = sum(size.values()), set()
    while True:
        level = (total - sum(3 * size[s] for s in capped)) / sum(weight[s] for s in names if s not in capped)
        over = {s for s in names if s not in capped and weight[s] * level > 3 * size[s] + 1e-9}
        if not over:
            break
        capped |= over
    want = {s: 3 * size[s] if s in capped else weight[s] * level for s in names}
    taken = Counter()
    source = {r[0]: r[3] for r in rows() if r[0] is not None}
    for r in found:
        if r.doc_id is not None:
            assert r.source_size == size[source[r.doc_id]] and abs(r.target - want[source[r.doc_id]]) < 1e-6
            taken[source[r.doc_id]] += r.taken
        assert r.taken <= 3 * r.size and (r.size == 0 or r.taken % r.size == 0)
    again = mixing.mix_sources(docs.repartition(7)).collect()
    assert Counter(map(tuple, again)) == Counter(map(tuple, found))


def test_mix_comes_near_its_targets(spark):
    rng = random.Random(41)
    made = [(k, "w " * min(3000, int(rng.paretovariate(1.1) * 8)), ("a", "b", "c", "d", None)[min(4, int(rng.expovariate(0.8)))]) for k in range(4000)]
    made += [(5000, "w " * 40, "b")] * 300  # repeated rows are documents of their own
    found = mixing.mix_sources(spark.createDataFrame(made, "doc_id long, text string, source string")).collect()
    source = {k: s for k, _, s in made}
    taken, target = Counter(), {}
    for r in found:
        taken[source[r.doc_id]] += r.taken
        target[source[r.doc_id]] = r.target
    assert len(found) == len(made) and all(abs(taken[s] - target[s]) <= 0.02 * target[s] + 60 for s in target), (taken, target)


def test_flight_keeps_totals_and_probabilities():
    rng = np.random.default_rng(3)
    size = rng.integers(1, 500, 400)
    hits = np.zeros(400)
    for seed in range(60):
        draw, pi = np.random.default_rng(seed), np.full(400, 0.3)
        mixing.flight(pi, size, draw.random, False)
        left = (pi > 0) & (pi < 1)
        assert left.sum() <= 2 and abs(pi @ size - 0.3 * size.sum()) < 1e-6 * size.sum() and abs(pi.sum() - 120) < 1e-6
        hits += pi
    assert abs(hits.mean() / 60 - 0.3) < 1e-9 and hits.std() / 60 < 0.1


def test_personal_data(docs, spark):
    made = [(k, f"write to user{k}@mail{k}.example.com or +1 (559) 555-{1000 + k}, card 4111 1111 1111 1111, host 10.0.0.{k}, 300.1.1.1") for k in range(8)] + [(90, None), (91, ""), (91, "")]
    r = {x.doc_id: x for x in pii.personal_data(spark.createDataFrame(made, "doc_id long, text string")).collect()}
    assert (r[3].n_email, r[3].n_ip, r[3].n_card, r[3].n_phone) == (1, 1, 1, 1) and r[90].spans == "" and r[90].base_sha256 == hashlib.sha256(b"").hexdigest()
    assert len(pii.personal_data(docs).collect()) == docs.count()


def test_base_personal_data_equals_the_stated_patterns():
    rng = random.Random(9)
    made = ["a@b.c", "4111 1111 1111 1111", "55000000-00000004", "1.2.3.4", "+49 30 1234567", "x.y", "@", ".", "-", " ", "1", "12", "255", "256", "4111", "1111", "+1", "(", ")", "é", "\n", "+", "555", "a", "_"]
    email = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
    ip = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
    card = re.compile(r"[0-9]([\x20-]?[0-9])+")
    phone = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
    digits = lambda t: "".join(c for c in t if c in "0123456789")
    hit = Counter()
    for _ in range(20_000):
        text = "".join(rng.choice(made) for _ in range(rng.randrange(1, 16)))
        want = {"email": [m.span() for m in email.finditer(text)], "ip": [m.span() for m in ip.finditer(text) if all(int(x) <= 255 for x in m[0].split("."))],
                "card": [m.span() for m in card.finditer(text) if 16 <= len(digits(m[0])) <= 19 and pii.luhn(digits(m[0]))], "phone": [m.span() for m in phone.finditer(text) if 8 <= len(digits(m[0])) <= 15]}
        assert pii.base_spans(text) == want, text
        hit.update({k: len(v) for k, v in want.items()})
    assert min(hit[k] for k in pii.KINDS) > 20


def test_context_discovers_unseen_identifiers(spark):
    """Numbers that miss the base form are found where their contexts are those of known ones, and nowhere else."""
    made = [(k, f"please call our office on +1 (559) 555-{1000 + k} today for help") for k in range(12)]
    made += [(100, "please call our office on (559) 555-7777 today for help"), (101, "lot size was 559 555 7778 in the old list")]
    r = {x.doc_id: x for x in pii.personal_data(spark.createDataFrame(made, "doc_id long, text string")).collect()}
    text = dict(made)
    start = text[100].index("(559)")
    assert r[100].spans == f"phone:{start}:{start + 14}" and r[100].n_added == 1 and r[100].n_phone == 0
    assert r[101].spans == ""
    masked = {x.doc_id: x.text for x in pii.without_personal_data(spark.createDataFrame(made, "doc_id long, text string")).collect()}
    assert masked[100] == "please call our office on <PHONE> today for help" and masked[101] == text[101]


def test_context_discovers_identifiers_of_any_shape(spark):
    made = [(k, f"please call our office on +1 (559) 555-{1000 + k} today for help, mail desk writer user{k}@mail{k}.example.com with questions, blocked node address 10.0.0.{k} since monday") for k in range(200)]
    found = {300: ("please call our office on ", "030 1234567", " today for help", "phone"), 301: ("please call our office on ", "01 23 45 67 89", " today for help", "phone"),
             302: ("mail desk writer ", "root@localhost", " with questions", "email"), 303: ("blocked node address ", "2001:db8::1", " since monday", "ip")}
    made += [(k, a + x + b) for k, (a, x, b, _) in found.items()]
    before, chain = "our office on", (64, 21, 7, 2)
    for step, size in enumerate(chain, 1):  # a pattern's numbers are known only once the one before has been
        after = f"desk{step} line{step} at{step}"
        for k in range(size):
            number = f"0{step}0 77{k:03} {step}"
            made += [(1000 * step + k, f"{before} {number} today"), (1000 * step + 500 + k, f"{after} {number} today")]
        before = after
    made += [(900, "there were 030 1234567 grains and 01 23 45 67 80 stones")]
    r = {x.doc_id: x for x in pii.personal_data(spark.createDataFrame(made, "doc_id long, text string")).collect()}
    for k, (a, x, _, kind) in found.items():
        assert r[k].spans == f"{kind}:{len(a)}:{len(a) + len(x)}"
    missed = [(step, k) for step, size in enumerate(chain, 1) for k in range(size) if r[1000 * step + k].n_added != 1]
    assert not missed and r[900].spans == ""


SECRET = 'token = "abcdef123456"'


def wrapped(data):
    return base64.b64encode(data if isinstance(data, bytes) else data.encode()).decode()


def test_secrets(docs):
    for inner in (urllib.parse.quote(SECRET, safe=""), wrapped(SECRET), wrapped(gzip.compress(SECRET.encode())), urllib.parse.quote(wrapped(wrapped(SECRET))), "".join(f"\\u{ord(c):04x}" for c in SECRET)):
        text = f"wörd {inner} end"
        found = secrets.layered(text)
        _, s, e, _ = found[0]
        assert 5 <= s < e <= 5 + len(inner)
    assert secrets.layered("nothing here but ThisIsAnOrdinaryIdentifier0 and words") == []
    found = secrets.secrets(docs).collect()
    assert len(found) == docs.count() and all(r.spans == ("hex:0:600" if r.doc_id == 56 else "") for r in found)


def test_secrets_of_escapes_have_exact_spans():
    for inner, lo, hi in (("é%C3%A9token%3Dabcdef%31&#50;\\u0033 x", 7, 35), ("&#116;oken=%61bcdefgh%20", 0, 21), ("\\x74oken=abcdef%ff", 0, 15)):
        assert {f[:3] for f in secrets.layered(inner)} >= {("assign", lo, hi)}, inner


def test_secrets_of_equal_blobs_paths_and_wrapped_lines():
    blob = wrapped(SECRET)
    found = secrets.layered(f"{blob} and {blob}")
    assert [f[1] for f in found] == [0, len(blob) + 5]
    for before in ("https://host.com/x/", "id-", "a_", "word/"):
        assert [f[0] for f in secrets.layered(before + blob)] == ["assign"]
    lines = base64.encodebytes(b"some words before it " * 3 + SECRET.encode() + b" and more words after it" * 4).decode()
    assert [f[0] for f in secrets.layered(lines)] == ["assign"]
    binary = wrapped(bytes(range(256)) + SECRET.encode() + bytes(range(160, 256)))  # mostly no text
    assert "assign" in {f[0] for f in secrets.layered(binary)}


def test_secrets_in_later_members_and_long_blobs(monkeypatch):
    parts = (b"nothing in the first one, ", SECRET.encode(), b"and after")
    packs = (gzip.compress, zlib.compress, zstandard.ZstdCompressor().compress)
    for pack in packs:
        found = secrets.layered(f"see {wrapped(b''.join(map(pack, parts)) + b'junk')} end")
        assert {f[0] for f in found} == {"assign"}
        assert {f[0] for f in secrets.layered(wrapped(b"junk" + pack(SECRET.encode() * 9)))} == {"assign"}
    monkeypatch.setattr(secrets, "PIECE", 64)
    for pack in packs:  # at every place relative to the cuts
        for k in range(0, 130, 7):
            data = b"x, " * k + SECRET.encode() + b" ,y" * 50
            assert "assign" in {f[0] for f in secrets.layered(wrapped(pack(data)))}, k


def test_secrets_of_deep_nests_in_linear_time():
    assert secrets.layered("%25" * 50) == [] and not [f for f in secrets.layered("%2525252525252525") if f[0] != "hex"]
    deep = "token%" + "25" * 50_000 + "3Dabcdefgh"
    began = time.time()
    assert ("assign", 0, len(deep)) in {f[:3] for f in secrets.layered(deep)}
    assert time.time() - began < 20
    mixed = "%3D"
    for k in range(400):  # an escape of % and one of the backslash in turn
        mixed = mixed.replace("%", "\\u0025", 1) if k % 2 == 0 else mixed.replace("\\", "%5C", 1)
    assert ("assign", 0, len(mixed) + 13) in {f[:3] for f in secrets.layered(f"token{mixed}abcdefgh")}
    nested = SECRET
    for _ in range(12):
        nested = wrapped(nested)
    assert {f[0] for f in secrets.layered(nested)} == {"assign"}


def test_base_secrets_equal_the_stated_patterns():
    """Random strings over the characters that matter, against the patterns as they are stated."""
    rng = random.Random(5)
    made = ["token", "API_KEY", "apikey", "Secret", "passwd", "password", "=", ":", " ", '"', "'", "AKIA", "ABCDEFGHIJ", "0123456789", "abcdef", "x", "-", "é", "\n", "K", "ſ"]
    assign, access, hexes = re.compile(r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.A), re.compile("AKIA[A-Z0-9]+"), re.compile("[0-9a-f]+")
    hit = Counter()
    for _ in range(20_000):
        text = "".join(rng.choice(made) for _ in range(rng.randrange(1, 14)))
        want = [("assign", *m.span()) for m in assign.finditer(text) if len(m[2]) >= 6]
        want += [("access", *m.span()) for m in access.finditer(text) if m.end() - m.start() >= 20]
        want += [("hex", *m.span()) for m in hexes.finditer(text) if m.end() - m.start() >= 24]
        assert sorted(secrets.base_spans(text)) == sorted(want), text
        hit.update(k for k, _, _ in want)
    assert min(hit[k] for k in secrets.KINDS) > 20


def test_language_of_held_out_rows(spark):
    """Learned from one part, measured on the other, which the sample never holds."""
    rng = random.Random(3)
    stems = {"en": "the of and to in is that ing ation er".split(), "de": "der die und ich sch ein keit ung ver st".split(), "fr": "le la et de eux ique ment tion que es".split()}
    made = [(k, lang := ("en", "de", "fr")[k % 3], " ".join("".join(rng.choice(stems[lang]) for _ in range(rng.randrange(1, 4))) for _ in range(rng.randrange(8, 60)))) for k in range(900)]
    d = spark.createDataFrame([(k, t, lang) for k, lang, t in made], "doc_id long, text string, lang string")
    seen = language_id.fit(d.filter("crc32(cast(doc_id as string)) % 4 = 2"))
    assert seen is None
    found = {r.doc_id: r for r in language_id.identify(d, language_id.fit(d, per_language=150)).collect()}
    held = [(k, lang) for k, lang, _ in made if zlib.crc32(str(k).encode()) % 4 == 2]
    assert {k for k in found if found[k].held_out} == {k for k, _ in held} and len(held) > 150
    assert sum(found[k].lang_pred == lang for k, lang in held) >= 0.97 * len(held)
    assert language_id.identify(d.limit(0), None).count() == 0


def test_language(spark, docs, empty):
    net = language_id.fit(docs, per_language=50)
    found = language_id.identify(docs, net).collect()
    assert len(found) == docs.count()
    for r in found:
        assert 0 <= r.score <= 1 and r.lang_pred in ("en", "de", "und")
    by = {r.doc_id: r for r in found}
    assert by[40].lang_pred == by[41].lang_pred == by[42].lang_pred == "und" and by[45].lang_pred != "und"
    assert language_id.fit(empty) is None
    assert {r.lang_pred for r in language_id.identify(docs, None).collect()} == {"und"}


def test_language_tables_equal_the_filters():
    net = language_id.ByteConvNet(["a", "b"])
    net.dense[:] = np.random.default_rng(0).normal(size=net.dense.shape)
    net.compile()
    codes = np.random.default_rng(1).integers(0, 64, (40, language_id.WINDOW)).astype(np.uint8)
    value, _ = net.pooled(codes)
    want = language_id._softmax(np.maximum(value + net.bias, 0) @ net.dense + net.out)
    assert np.allclose(net.probabilities(codes), want, atol=1e-4)


def test_toxicity(spark, docs, empty):
    made = [(k, f"{'rotten scum ' if k % 3 == 0 else 'kind friend '}{k} " + "plain filler words here " * 5) for k in range(90)]
    d = spark.createDataFrame(made, "doc_id long, text string")
    labels = spark.createDataFrame([(k, 1, int(k % 3 == 0)) for k in range(90)] + [(3, 1, None), (None, 1, 1)], "doc_id long, quality int, toxic int")
    scorer = toxicity.fit(d, labels)
    found = toxicity.score_toxicity(d, scorer).collect()
    assert all(r.predicted == int(r.doc_id % 3 == 0) for r in found) and all(0 <= r.score <= 1 for r in found)
    assert {r.doc_id for r in toxicity.without_toxic(d, scorer).collect()} == {k for k in range(90) if k % 3}
    assert len(toxicity.score_toxicity(docs, scorer).collect()) == docs.count()
    assert toxicity.fit(empty, labels) is None and toxicity.score_toxicity(docs, None).first().score == 0


def test_toxicity_of_held_out_rows_and_rare_words(spark):
    """Learned from one part, measured on the other; a toxic word of few examples counts too, and equal texts vote by their share."""
    rng = random.Random(17)
    plain = [f"w{k}" for k in range(400)]
    insults = ["scum", "moron", "trash", "loser", "rareinsult"]
    made, marks = [], []
    for k in range(1500):
        text = [rng.choice(plain) for _ in range(rng.randrange(5, 120))]
        if toxic := k % 5 == 1 or k % 25 == 0:
            for _ in range(2):
                text.insert(rng.randrange(len(text)), rng.choice(insults[:4]) if rng.random() < 0.97 else insults[4])
        made.append((k, " ".join(text)))
        marks.append((k, 1, int(toxic)))
    made += [(2000 + k, "both ways") for k in range(10)] + [(3000, ""), (3001, None), (3002, "rareinsult")]
    marks += [(2000 + k, 1, int(k < 9)) for k in range(10)]
    docs = spark.createDataFrame(made, "doc_id long, text string")
    labels = spark.createDataFrame(marks, "doc_id long, quality int, toxic int")
    found = {r.doc_id: r for r in toxicity.score_toxicity(docs, toxicity.fit(docs, labels)).collect()}
    truth = {k: t for k, _, t in marks if k < 1500}
    held = [k for k in truth if zlib.crc32(str(k).encode()) % 5 == 0]
    assert {k for k in truth if found[k].held_out} == set(held) and len(held) > 200
    right = sum(found[k].predicted == truth[k] for k in held)
    hit = [found[k].predicted for k in held if truth[k]]
    assert right >= 0.98 * len(held) and sum(hit) >= 0.95 * len(hit)
    assert found[3002].predicted == 1 and found[3000].score == found[3001].score < 0.5
    again = {r.doc_id: r.score for r in toxicity.score_toxicity(docs, toxicity.fit(docs.repartition(7), labels.repartition(3))).collect()}
    assert all(abs(again[k] - found[k].score) < 1e-9 for k in again)  # conflicting labels of equal texts included


def test_block_max_search_is_exact():
    rng = np.random.default_rng(2)
    n, terms = 700, 300
    often = rng.random(terms) ** 6 * 0.5
    dense = rng.random((n, terms)) * (rng.random((n, terms)) < often)
    dense /= np.maximum(np.sqrt((dense**2).sum(1, keepdims=True)), 1e-9)
    doc, term = np.nonzero(dense)
    index = toxicity.BlockMaxIndex(doc, term, dense[doc, term], n, terms)
    assert 0 < index.postings.shape[1] < terms  # both kinds of postings
    best, which = index.search(doc, term, dense[doc, term], n, 10)
    want = -np.sort(-(dense @ dense.T), axis=1)[:, :10]
    assert np.abs(best - want).max() < 1e-5
    assert np.abs(np.where(which >= 0, (dense @ dense.T)[np.arange(n)[:, None], which], 0) - best).max() < 1e-5
    few = toxicity.BlockMaxIndex(doc[doc < 5], term[doc < 5], dense[doc, term][doc < 5], 5, terms)
    best, which = few.search(doc, term, dense[doc, term], n, 10)
    assert np.abs(best[:, :5] + np.sort(-(dense @ dense[:5].T), axis=1)).max() < 1e-5 and (which[:, 5:] == -1).all()


def test_labelled_samples_are_bounded_and_whole(spark):
    """Copies and a hot key neither exceed the bound nor push out a class."""
    from threadloom.llm.shared import stratified

    made = [(7, "hot", "the same text")] * 3000 + [(k, ("a", "b")[k % 2], f"text {k % 700}") for k in range(4000)] + [(1, None, "x"), (2, "a", None)]
    got = stratified(spark.createDataFrame(made, "doc_id long, lang string, text string"), "lang", "text", 100).collect()
    assert Counter(r.lang for r in got) == {"hot": 1, "a": 100, "b": 100} and len({(r.lang, r.text) for r in got}) == 201
    assert stratified(spark.createDataFrame([], "doc_id long, lang string, text string"), "lang", "text", 5).count() == 0


def test_decontamination(spark, docs, empty):
    rng = np.random.default_rng(4)
    word = lambda: "".join(rng.choice(list("abcdefghij"), 6))
    items = [(k, " ".join(word() for _ in range(n))) for k, n in enumerate((40, 25, 15, 6, 3))] + [(8, None), (9, "")]
    clean = [(100 + k, " ".join(word() for _ in range(80))) for k in range(20)]
    swapped = items[0][1].split()
    swapped[5] = swapped[14] = swapped[23] = "other"
    made = clean + [(0, f"{word()} {items[0][1].upper()}, {word()}"), (1, f"{word()} {' '.join(swapped)} {word()}"), (2, " ".join(items[1][1].split()[5:20])), (3, f"x {items[3][1]} y"), (4, f"x {items[4][1]} y"), (5, None), (6, "")]
    d, b = spark.createDataFrame(made, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    want = {0, 1, 2, 3, 4}
    found = decontaminate.decontaminate(d, b).collect()
    assert {r.doc_id for r in found if r.contaminated} == want and len(found) == len(made)
    assert {r.doc_id for r in decontaminate.without_leaks(d, b).collect()} == {m[0] for m in made} - want
    assert decontaminate.decontaminate(docs, b).count() == docs.count()
    assert not decontaminate.decontaminate(d, b.limit(0)).filter("contaminated").collect()
    assert decontaminate.decontaminate(empty, b).count() == 0


def leak(text, item):
    """Equal tokens of the largest overlap over all diagonals with an agreeing mask, pair by pair; 0 if it is too small."""
    n, most = len(item), 0
    masks = decontaminate.MASKS if n >= 5 else ["1" * n]
    for d in range(-n + 1, len(text)):
        same = [text[i] == item[i - d] for i in range(max(0, d), min(len(text), d + n))]
        if not any(all(same[k + j] for j, bit in enumerate(m) if bit == "1") for m in masks for k in range(len(same) - len(m) + 1)):
            continue
        score = least = top = 0
        start = begin = end = 0
        for k, x in enumerate(same):
            score += 1 if x else -2
            if score - least > top:
                top, begin, end = score - least, start, k + 1
            if score < least:
                least, start = score, k + 1
        equal = sum(same[begin:end])
        if equal >= (12 if n > 12 else max(1, -(-8 * n // 10))):
            most = max(most, equal)
    return most


def test_decontamination_equals_brute_force(spark):
    rng = random.Random(23)
    items = []
    for k in range(14):
        n = rng.choice((1, 2, 4, 5, 6, 8, 12, 13, 30, 60))
        items.append([rng.choice("abcdefghijklmnopqrstuvwxyz") * (1 + k % 3) for _ in range(n)] if k % 4 else [rng.choice("xy") for _ in range(n)])
    texts = []
    for k in range(60):
        text = [rng.choice("abcdefghijklmnopqrstuvwxyz") * rng.randrange(1, 4) for _ in range(rng.randrange(0, 40))]
        if k % 3:
            part = list(rng.choice(items))
            lo = rng.randrange(len(part))
            part = part[lo : lo + rng.randrange(1, 40)]
            for _ in range(rng.randrange(3)):
                part[rng.randrange(len(part))] = "other"
            text[len(text) // 2 : len(text) // 2] = part
        texts.append(text if k % 10 else ["x"] * 30 + ["y", "x"] * 9)
    d = spark.createDataFrame([(k, " ".join(t)) for k, t in enumerate(texts)] + [(None, " ".join(texts[1]))], "doc_id long, text string")
    b = spark.createDataFrame([(k, " ".join(t)) for k, t in enumerate(items)], "item_id long, text string")
    found = {r.doc_id: r for r in decontaminate.decontaminate(d, b).collect()}
    hits = 0
    for k, t in enumerate(texts):
        every = {i: e for i, x in enumerate(items) if (e := leak(t, x))}
        hits += bool(every)
        want = (len(every), max(every.values(), default=0), min((i for i, e in every.items() if e == max(every.values())), default=None))
        assert (found[k].n_items, found[k].equal_tokens, found[k].item_id) == want, (k, every)
    assert hits > 20 and found[None].n_items == found[1].n_items


def test_decontamination_of_repeated_tokens():
    began = time.time()
    word = np.full(20_000, 7, np.uint64)
    assert decontaminate.overlap(decontaminate.Tokens(word), decontaminate.Tokens(word[:500]))[0] == 500
    pair = np.tile(np.array([7, 8], np.uint64), 5_000)
    assert decontaminate.overlap(decontaminate.Tokens(pair), decontaminate.Tokens(pair[:1000]))[0] == 1000
    assert time.time() - began < 30


def test_empty_tables(empty):
    assert near_dedup.near_duplicates(empty).count() == 0
    assert pii.personal_data(empty).count() == 0
    assert mixing.mix_sources(empty).count() == 0
    assert fingerprints.fingerprints(empty).count() == 0
    assert repeats.repeated_substrings(empty).count() == 0
    assert paragraphs.repeated_paragraphs(empty).count() == 0
    assert secrets.secrets(empty).count() == 0


def test_pipeline_stages_bound_their_batches(spark):
    import corpus_pipeline

    setting = "spark.sql.execution.arrow.maxRecordsPerBatch"
    old = spark.conf.get(setting)
    docs = spark.createDataFrame([(k, f"words of text {k}", "en", "web", 15) for k in range(5000)], "doc_id long, text string, lang string, source string, n_chars long").coalesce(1)

    def sizes(batches):
        import pyarrow as pa

        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([b.num_rows])], names=["n"])

    try:
        spark.conf.set(setting, 10_000)
        corpus_pipeline.mix_to_weights(spark, docs, "")
        found = [r.n for r in docs.mapInArrow(sizes, "n long").collect()]
        assert sum(found) == 5000 and max(found) <= 1024
        spark.conf.set(setting, 100)
        corpus_pipeline.mask_personal_data(spark, docs.limit(10), "")
        assert spark.conf.get(setting) == "100"
    finally:
        spark.conf.set(setting, old)


def test_pipeline(spark, tmp_path):
    import corpus_pipeline
    from threadloom.llm.shared import stage

    made = rows()
    passage = made[51][1]
    rng = random.Random(77)
    for k in range(60):  # labelled rows, a third of them toxic, and two more nobody labelled
        text = " ".join(f"plain{rng.randrange(300)}" for _ in range(30))
        made.append((1000 + k, f"{text} rotten scum {text[:20]}" if k % 3 == 0 else text, "en", "a", 1) + made[0][5:])
    made += [(2000, "a mail to rotten scum there", "en", "a", 1) + made[0][5:], (2001, "please write to jane@example.com about it", "en", "b", 1) + made[0][5:]]
    path = save(spark, str(tmp_path / "d"), made, [(k, 1, 0) for k in range(40)] + [(1000 + k, 1, int(k % 3 == 0)) for k in range(60)], [(1, passage)])
    docs = spark.read.parquet(f"{path}/documents.parquet")
    columns = docs.columns
    for name, f in corpus_pipeline.STAGES:
        before = {r.doc_id: r for r in docs.collect()}
        docs = stage(f(spark, docs, path), name)
        after = {r.doc_id: r for r in docs.collect()}
        assert set(after) <= set(before)
        if name != "mixing":
            assert docs.columns == columns
        if name == "toxicity":
            assert not {2000, *(1000 + k for k in range(0, 60, 3))} & set(after) and {1000 + k for k in range(60) if k % 3} <= set(after)
        if name == "near_duplicates":
            assert 0 in after and 47 not in after and 48 not in after and 2 in after
        if name == "decontamination":
            assert 51 in before and 51 not in after and 0 in after
        if name == "personal_data":
            assert set(after) == set(before) and after[2001].text == "please write to <EMAIL> about it" and after[2001].n_chars == len(after[2001].text)
    assert corpus_pipeline.run(spark, path).count() == docs.count() > 20
    empty = save(spark, str(tmp_path / "e"), [])
    assert corpus_pipeline.run(spark, empty).count() == 0
