"""Personal data: exact base patterns, and bootstrapped contextual extraction on top of them.

One pass over whole texts yields the base spans (seeds) and candidates, each with the words around it: loose forms of
one kind, and all other spans of a generic class, which may be of several kinds: digits with separators, groups between
colons, tokens with an @. The words form lexical patterns; Spark then scores the pattern-instance graph in
rounds, until one accepts nothing new: a pattern's confidence is the share of its distinct instances that are known, an instance is
accepted when the confidences of its high-confidence patterns leave less than ``DOUBT`` of doubt, and accepted
instances are known in the next round. Candidates that are accepted add spans, each of the kind of least doubt; base
spans always stay.

A null text counts as empty: no span. Repeated rows get equal spans; a null doc_id is allowed, as spans
belong to texts, which are joined by hash and length. Other columns are ignored.
"""

from __future__ import annotations

import hashlib
import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import small, stage

KINDS = ("email", "ip", "card", "phone")
#: A pattern counts once so many distinct known instances carry it, at this share of all its instances.
LEAST_KNOWN = 4
LEAST_CONFIDENCE = 0.75
DOUBT = 0.1

_DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_DIGIT = re.compile(r"[0-9]")
_LOCAL_SET = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_LOOSE = (
    ("email", re.compile(r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++ ?[\[(](?:at|AT)[\])] ?[A-Za-z0-9-]+(?: ?[\[(](?:dot|DOT)[\])] ?[A-Za-z0-9-]+|\.[A-Za-z0-9-]+)+")),
    ("ip", re.compile(r"(?<![0-9A-Fa-f:])[0-9A-Fa-f]{1,4}(?::[0-9A-Fa-f]{1,4}){7}(?![0-9A-Fa-f:])")),
    ("card", re.compile(r"(?<![0-9A-Za-z.+-])[0-9]{4}(?:[ -]?[0-9]{4}){2}[ -]?[0-9]{1,7}(?![0-9A-Za-z-])")),
    ("phone", re.compile(r"(?<![0-9A-Za-z.+)(-])(?:00[0-9]{1,3}[ -])?(?:\([0-9]{3}\) ?|[0-9]{3}[ .-])[0-9]{3}[ .-][0-9]{4}(?![0-9A-Za-z-])")),
)
#: Spans that may fill the slot of a pattern, and the kinds of slots.
_GENERIC = (
    (("email",), re.compile(r"(?<![^\s<>()\[\]{},;:\"'])[^\s@<>()\[\]{},;:\"']++@[^\s@<>()\[\]{},;:\"']*[^\W_]")),
    (("ip",), re.compile(r"(?<![^\W_])(?<!:)(?=[0-9A-Fa-f:]*[0-9])[0-9A-Fa-f]{0,4}+(?::[0-9A-Fa-f]{0,4}+){2,}+(?![^\W_])")),
    (("ip", "card", "phone"), re.compile(r"(?<![^\W_])(?:\+ ?\(?|\()?[0-9]++(?:(?:\) ?| \(|\(| - |[ .:/-])?[0-9]++)*+(?![^\W_])")),
)
_WORD_LEFT = re.compile(r"(\w+)\W*\Z")
_WORD_RIGHT = re.compile(r"\A\W*(\w+)")
_CONTEXT = 64


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if k % 2 == 0 else (2 * d - 9 if d > 4 else 2 * d)
    return total % 10 == 0


def emails(text: str) -> list[tuple[int, int]]:
    """Leftmost non-overlapping matches, in time linear in the text: every match turns on its @ sign."""
    found, floor, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > floor and text[start - 1] in _LOCAL_SET:
            start -= 1
        if start < at and (m := _DOMAIN.match(text, at)):
            found.append((start, m.end()))
            floor = m.end()
            at = text.find("@", floor)
            continue
        floor = max(floor, at + 1)
        at = text.find("@", at + 1)
    return found


def base_spans(text: str) -> dict[str, list[tuple[int, int]]]:
    """The base spans of each kind, code points, end exclusive."""
    found = {k: [] for k in KINDS}
    if "@" in text:
        found["email"] = emails(text)
    if _DIGIT.search(text):
        for m in _IP.finditer(text):
            if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split(".")):
                found["ip"].append(m.span())
        for m in _CARD.finditer(text):
            if 16 <= m.end() - m.start():
                digits = m[0].replace(" ", "").replace("-", "")
                if 16 <= len(digits) <= 19 and luhn(digits):
                    found["card"].append(m.span())
        if "+" in text:
            for m in _PHONE.finditer(text):
                if 8 <= sum("0" <= c <= "9" for c in m[0]) <= 15:
                    found["phone"].append(m.span())
    return found


def joined(spans) -> str:
    """``kind:start:end`` by kind as listed, then start."""
    return ",".join(f"{k}:{s}:{e}" for k, s, e in sorted(spans, key=lambda x: (KINDS.index(x[0]), x[1], x[2])))


def _patterns(text: str, start: int, end: int) -> list[str]:
    """Lexical patterns: the word pair before, and the word before with the word after."""
    left, words = text[max(0, start - _CONTEXT) : start], []
    while len(words) < 2 and (m := _WORD_LEFT.search(left)):
        words.append(m[1].lower())
        left = left[: m.start()]
    right = m[1].lower() if (m := _WORD_RIGHT.match(text[end : end + _CONTEXT])) else "$"
    words += ["^"] * (2 - len(words))
    return [f"{words[1]} {words[0]} _", f"{words[0]} _ {right}"]


def occurrences(text: str, base: dict[str, list[tuple[int, int]]]) -> list[tuple]:
    """``(kind, start, end, instance, seed, patterns)`` of base spans and of candidates that overlap none."""
    found = []
    for kind, spans in base.items():
        found += [(kind, s, e, text[s:e].lower(), True, _patterns(text, s, e)) for s, e in spans]
    digits = bool(_DIGIT.search(text))
    if not digits and "@" not in text and not any(x in text for x in ("(at)", "[at]", "(AT)", "[AT]")):
        return found
    covered = bytearray(len(text))
    for a, b in (x for spans in base.values() for x in spans):
        covered[a:b] = b"\1" * (b - a)
    for kinds, form in (*(((kind,), loose) for kind, loose in _LOOSE), *_GENERIC):
        if not digits and kinds != ("email",):
            continue
        if form is _LOOSE[0][1] and not any(x in text for x in ("(at)", "[at]", "(AT)", "[AT]")) or form is _GENERIC[0][1] and "@" not in text or kinds == ("ip",) and text.count(":") < 2:
            continue
        for m in form.finditer(text):
            s, e = m.span()
            if not any(covered[s:e]):
                covered[s:e] = b"\1" * (e - s)
                patterns = _patterns(text, s, e)
                found += [(kind, s, e, m[0].lower(), False, patterns) for kind in kinds]
    return found


FOUND = "doc_id long, h long, n long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, base string, occ array<struct<kind: string, s: int, e: int, inst: string, seed: boolean, pats: array<string>>>"
_OCC = pa.list_(pa.struct([("kind", pa.string()), ("s", pa.int32()), ("e", pa.int32()), ("inst", pa.string()), ("seed", pa.bool_()), ("pats", pa.list_(pa.string()))]))


def _scan(batches):
    for batch in batches:
        rows, empty = {k: [] for k in ("n", *KINDS, "sha", "base", "occ")}, hashlib.sha256(b"").hexdigest()
        for text in batch.column(1).to_pylist():
            text = text or ""
            rows["n"].append(len(text))
            base = base_spans(text)
            listed = joined((k, s, e) for k, spans in base.items() for s, e in spans)
            for k in KINDS:
                rows[k].append(len(base[k]))
            rows["sha"].append(hashlib.sha256(listed.encode()).hexdigest() if listed else empty)
            rows["base"].append(listed)
            occ = occurrences(text, base)
            rows["occ"].append([dict(zip(("kind", "s", "e", "inst", "seed", "pats"), o)) for o in occ])
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), batch.column(2), pa.array(rows["n"], pa.int64()), *(pa.array(rows[k], pa.int64()) for k in KINDS), pa.array(rows["sha"], pa.string()), pa.array(rows["base"], pa.string()), pa.array(rows["occ"], _OCC)],
            names=["doc_id", "h", "n", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "base", "occ"],
        )


def scan(docs: DataFrame) -> DataFrame:
    """Base spans and occurrences of every row, staged; texts are read once and not moved."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64(F.coalesce("text", F.lit(""))).alias("h"))
    return stage(rows.mapInArrow(_scan, FOUND), "pii")


def bootstrap(found: DataFrame) -> DataFrame:
    """``h, n, kind, s, e`` of candidates that the graph of patterns and instances makes certain."""
    occ = found.select("h", "n", F.explode("occ").alias("o")).select("h", "n", "o.*").distinct()
    graph = stage(occ.select("kind", "inst", "seed", F.explode("pats").alias("pat")).groupBy("kind", "inst", "pat").agg(F.max("seed").alias("seed")), "graph")
    seeds = graph.filter("seed").select("kind", "inst").distinct()
    known, accepted = seeds, 0
    while True:
        marked = graph.join(known.withColumn("known", F.lit(1)), ["kind", "inst"], "left").withColumn("known", F.coalesce("known", F.lit(0)))
        strong = (
            marked.groupBy("kind", "pat").agg(F.count(F.lit(1)).alias("all"), F.sum("known").alias("f"))
            .withColumn("conf", F.col("f") / F.col("all")).filter((F.col("f") >= LEAST_KNOWN) & (F.col("conf") >= LEAST_CONFIDENCE))
        )
        strong = stage(strong.select("kind", "pat", "conf"), "patterns")
        strong = small(strong, strong.count())  # few patterns meet many occurrences, so a hot one isn't one task's burden
        new = (
            graph.filter(~F.col("seed")).join(strong, ["kind", "pat"]).groupBy("kind", "inst")
            .agg(F.sum(F.ln(1 - F.least("conf", F.lit(0.999)))).alias("doubt")).filter(F.col("doubt") <= F.ln(F.lit(DOUBT)))
        )
        new = stage(new, "accepted")
        if (n := new.count()) <= accepted:  # confidences only grow, so nothing accepted is lost
            break
        accepted, known = n, stage(seeds.union(new.select("kind", "inst")).distinct(), "known")
    loose = occ.filter(~F.col("seed")).select("h", "n", "kind", "s", "e", "inst", F.explode("pats").alias("pat"))
    spans = loose.join(strong, ["kind", "pat"]).join(small(new, n), ["kind", "inst"])
    order = F.array_position(F.array(*map(F.lit, KINDS)), F.col("kind"))
    return spans.groupBy("h", "n", "s", "e").agg(F.min_by("kind", F.struct("doubt", order)).alias("kind")).select("h", "n", "kind", "s", "e")


def personal_data(docs: DataFrame) -> DataFrame:
    """One row for each of ``docs``: counts and digest of base spans, and all spans."""
    found = scan(docs)
    added = stage(bootstrap(found).groupBy("h", "n").agg(F.array_sort(F.collect_list(F.struct("kind", "s", "e"))).alias("added")), "added")
    added = small(added, added.count())
    rows = found.select("doc_id", "h", "n", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "base").join(added, ["h", "n"], "left")
    return rows.select("doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", _merge(F.col("base"), F.col("added")).alias("spans"), F.coalesce(F.size("added"), F.lit(0)).cast("long").alias("n_added"))


def _merge(base, added):
    """Both lists of spans as one string, by expressions only: kinds as listed, then start."""
    rank = lambda kind: F.array_position(F.array(*map(F.lit, KINDS)), kind).cast("int")
    old = F.transform(F.filter(F.split(base, ","), lambda x: x != ""), lambda x: F.struct(rank(F.split(x, ":")[0]).alias("r"), F.split(x, ":")[1].cast("int").alias("s"), F.split(x, ":")[2].cast("int").alias("e"), F.split(x, ":")[0].alias("k")))
    new = F.transform(added, lambda x: F.struct(rank(x["kind"]).alias("r"), x["s"].alias("s"), x["e"].alias("e"), x["kind"].alias("k")))
    text = F.array_join(F.transform(F.array_sort(F.concat(old, new)), lambda x: F.concat_ws(":", x["k"], x["s"], x["e"])), ",")
    return F.when(added.isNull(), base).otherwise(text)


def op3_pii(spark, sf_dir: str) -> DataFrame:
    return personal_data(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def _masked(text: str, added) -> str:
    spans = [(s, e, k) for k, found in base_spans(text).items() for s, e in found]
    spans += [(a["s"], a["e"], a["kind"]) for a in added or ()]
    parts, last = [], 0
    for s, e, kind in sorted(spans):
        if s >= last:
            parts += [text[last:s], f"<{kind.upper()}>"]
        last = max(last, e)
    return "".join([*parts, text[last:]])


def without_personal_data(docs: DataFrame) -> DataFrame:
    """The rows of ``docs``, all their columns, with every span in the text replaced by its kind; ``n_chars`` follows if there is one."""
    added = stage(bootstrap(scan(docs)).groupBy("h", "n").agg(F.array_sort(F.collect_list(F.struct("kind", "s", "e"))).alias("_pii_added")), "added")
    added = added.select(F.col("h").alias("_pii_h"), F.col("n").alias("_pii_n"), "_pii_added")
    key = (F.xxhash64(F.coalesce("text", F.lit(""))) == F.col("_pii_h")) & (F.length(F.coalesce("text", F.lit(""))) == F.col("_pii_n"))
    rows = docs.join(small(added, added.count()), key, "left").select(*docs.columns, "_pii_added")
    at, size = docs.columns.index("text"), docs.columns.index("n_chars") if "n_chars" in docs.columns else None

    def run(batches):
        for batch in batches:
            texts = [t if t is None else _masked(t, a) for t, a in zip(batch.column(at).to_pylist(), batch.column(len(docs_columns)).to_pylist())]
            cols = list(batch.columns[:-1])
            cols[at] = pa.array(texts, pa.string())
            if size is not None:
                cols[size] = pa.array([len(t) if t is not None else n for t, n in zip(texts, batch.column(size).to_pylist())], cols[size].type)
            yield pa.RecordBatch.from_arrays(cols, names=docs_columns)

    docs_columns = docs.columns
    return rows.mapInArrow(run, docs.schema)
