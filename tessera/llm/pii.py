"""Personal data and the terms that give it away.

Base spans (email, ip, card, phone) come from fixed patterns over whole texts, found in linear time. Secrets (keys, tokens)
have no pattern: they are runs of letters and digits that carry much information, by length and by the entropy of their
characters. Information-theoretic sanitisation adds terms: for every entity (the value of a base span or a secret), words
of any length within WINDOW words of a mention are counted over the distinct texts of the whole corpus, so that copies
count once. Entities part words and are none themselves. With N texts, a term t discloses an entity e as far as it lowers the information that e carries,

    disclosure(t, e) = log(P(e | t) / P(e)) / log(1 / P(e)),  P(e | t) = texts with t near e / texts with t,

which is 1 where t leaves no doubt. A term in enough distinct contexts (SUPPORT) is removed from REMOVE on
and generalised from GENERALISE on, wherever it stands in any text, as it gives the entity away without a mention too.
Counts cover all documents; what is shuffled are the words near mentions, the texts with those words (a fixed bitmap
lets other words go at once), and the places of disclosing terms.
"""

from __future__ import annotations

import hashlib
import re

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import Hasher, chunks, fitting, map_arrow, materialise, text_batches, utf8, word_spans

WINDOW, SUPPORT, REMOVE, GENERALISE = 8, 2, 0.95, 0.8
#: Characters of a secret, the entropy of one of them (bits), and changes between letters and digits.
SECRET, ENTROPY, CHANGES = 20, 3.0, 2
BITS = 20
#: Marks that a join may broadcast (about 10 MB); above it the join is shuffled.
MARKS = 200_000
KINDS = ("email", "ip", "card", "phone")
# Characters and patterns of the base kinds.
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
DOTTED = re.compile(r"[0-9]++(?:\.[0-9]++)*+")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGIT = re.compile(r"[0-9]")


def emails(text: str) -> list[tuple[int, int]]:
    out, last, at = [], 0, text.find("@")
    while at >= 0:
        begin = at
        while begin > last and text[begin - 1] in LOCAL:
            begin -= 1
        if begin < at and at >= last and (m := DOMAIN.match(text, at + 1)):
            out.append((begin, m.end()))
            last = m.end()
        at = text.find("@", max(at + 1, last))
    return out


def ips(text: str) -> list[tuple[int, int]]:
    """A run of dotted numbers gives its numbers by fours; a four with a part above 255 is dropped."""
    out = []
    for m in DOTTED.finditer(text):
        parts = m.group().split(".")
        begin = m.start()
        for i in range(0, len(parts) - 3, 4):
            size = sum(map(len, parts[i : i + 4])) + 3
            if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or "0") <= 255 for p in parts[i : i + 4]):
                out.append((begin, begin + size))
            begin += size + 1
    return out


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if i % 2 == 0 else d * 2 - 9 * (d > 4)
    return total % 10 == 0


def cards(text: str) -> list[tuple[int, int]]:
    out = []
    for m in CARD.finditer(text):
        digits = m.group().replace(" ", "").replace("-", "")
        if 13 <= len(digits) <= 19 and luhn(digits):
            out.append(m.span())
    return out


def phones(text: str) -> list[tuple[int, int]]:
    return [m.span() for m in PHONE.finditer(text) if 9 <= sum(c in "0123456789" for c in m.group()) <= 15]


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) in code points, by kind as listed and then by start."""
    out = [("email", *s) for s in emails(text)] if "@" in text else []
    if _DIGIT.search(text):
        out += [("ip", *s) for s in ips(text)] + [("card", *s) for s in cards(text)]
        if "+" in text:
            out += [("phone", *s) for s in phones(text)]
    return out


_ALNUM = np.zeros(256, bool)
_ALNUM[48:58] = _ALNUM[65:91] = _ALNUM[97:123] = True


def is_secret(run: str) -> bool:
    """Whether a run of ASCII letters and digits carries as much information as keys and tokens do."""
    counts = np.array([run.count(c) for c in set(run)]) / max(1, len(run))
    changes = sum(a.isdigit() != b.isdigit() for a, b in zip(run, run[1:], strict=False))
    return len(run) >= SECRET and changes >= CHANGES and float(-(counts * np.log2(counts)).sum()) >= ENTROPY


def secrets(raw: np.ndarray, at: np.ndarray) -> list[tuple[int, int, int]]:
    """(document, start, end) in the document's bytes of the secrets, in order."""
    inside = np.concatenate([[False], _ALNUM[raw], [False]])
    starts, ends = np.flatnonzero(inside[1:] & ~inside[:-1]), np.flatnonzero(inside[:-1] & ~inside[1:])
    long = np.flatnonzero(ends - starts >= SECRET)
    out = []
    for a, b in zip(starts[long].tolist(), ends[long].tolist(), strict=True):
        while a < b:  # texts that adjoin one another part a run
            doc = int(np.searchsorted(at, a, "right")) - 1
            end = min(b, int(at[doc + 1]))
            if end - a >= SECRET and is_secret(raw[a:end].tobytes().decode("ascii")):
                out.append((doc, a - int(at[doc]), end - int(at[doc])))
            a = end
    return out


def _hash(text: str) -> int:
    return int.from_bytes(hashlib.blake2b(text.encode("utf-8", "replace"), digest_size=8).digest(), "little", signed=True)


def _term_hash(data: bytes) -> int:
    raw = np.frombuffer(data, np.uint8)
    return int(Hasher(raw)(np.array([0]), np.array([len(raw)])).view(np.int64)[0])


def _without_base(raw: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, dict[int, list[tuple[str, int, int]]], dict[int, list[tuple[str, int, int]]]]:
    """The bytes with spaces for base spans and secrets, and both (kind, start, end in the document's bytes) of the documents
    that have any. The patterns are ASCII, so that bytes read as Latin-1 give the same spans."""
    out, spans, hidden = raw.copy(), {}, {}
    hints = np.flatnonzero((raw == 64) | (raw >= 48) & (raw <= 57))
    for i in np.unique(np.searchsorted(at, hints, "right") - 1).tolist():
        if found := base_spans(raw[at[i] : at[i + 1]].tobytes().decode("latin-1")):
            spans[i] = found
            for _, a, b in found:
                out[at[i] + a : at[i] + b] = 32
    for i, a, b in secrets(out, at):
        hidden.setdefault(i, []).append(("secret", a, b))
    for i, own in hidden.items():
        for _, a, b in own:
            out[at[i] + a : at[i] + b] = 32
    return out, spans, hidden


_EDGE = np.zeros(256, bool)
_EDGE[[ord(c) for c in ".,;:!?\"'()[]{}<>|*#$%& \t\n\x0b\x0c\r"]] = True


def _terms(raw: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words that are more than punctuation, and the hashes of their terms: words without
    punctuation around them, lower-cased (those with letters beyond ASCII one by one)."""
    starts, ends, _ = word_spans(raw, at)
    core = np.flatnonzero(~_EDGE[raw])
    first, last = np.searchsorted(core, starts), np.searchsorted(core, ends)
    fine = first < last
    starts, ends = starts[fine], ends[fine]
    if not len(starts):
        return starts, ends, np.zeros(0, np.int64)
    a, b = core[first[fine]], core[last[fine] - 1] + 1
    hashes = Hasher(raw, lower=True)(a, b)
    wide = np.concatenate([[0], np.cumsum(raw >= 128)])
    for i in np.flatnonzero(wide[b] > wide[a]).tolist():
        word = raw[a[i] : b[i]].tobytes().decode("utf-8", "replace")
        if (low := word.lower()) != word:
            hashes[i] = np.uint64(_term_hash(low.encode("utf-8", "replace")) & (2**64 - 1))
    return starts, ends, hashes.view(np.int64)


def _points(raw: np.ndarray) -> np.ndarray:
    """Code points before each byte."""
    return np.concatenate([[0], np.cumsum((raw & 0xC0) != 0x80)])


def _key(raw: np.ndarray) -> bytes:
    """What is equal for equal texts."""
    return hashlib.blake2b(raw.tobytes(), digest_size=16).digest()


def _find(window: int):
    def run(batches):
        import pyarrow as pa

        kind = pa.list_(pa.struct([("entity", pa.int64()), ("context", pa.int64()), ("term", pa.int64())]))
        names = ["doc_id", *(f"n_{k}" for k in KINDS), "base", "secrets", "key", "near"]
        for ids, raw, at in text_batches(batches, "doc_id", "text"):
            blank, spans, hidden = _without_base(raw, at)
            counts = [pa.array([sum(s[0] == k for s in spans.get(i, ())) for i in range(len(ids))], pa.int64()) for k in KINDS]
            keys = [_key(raw[at[i] : at[i + 1]]) for i in range(len(ids))]
            base, secret, near = [""] * len(ids), [""] * len(ids), [[] for _ in range(len(ids))]
            for i in sorted(spans.keys() | hidden.keys()):
                text, points = raw[at[i] : at[i + 1]], _points(raw[at[i] : at[i + 1]])
                base[i], secret[i] = (",".join(f"{k}:{points[a]}:{points[b]}" for k, a, b in of.get(i, ())) for of in (spans, hidden))
                own = spans.get(i, []) + hidden.get(i, [])
                starts, _, hashes = _terms(blank[at[i] : at[i + 1]], np.array([0, len(text)]))
                found = set()
                for k, a, b in own:
                    value = text[a:b].tobytes().decode("ascii")
                    entity = _hash(f"{k}:" + (re.sub(r"[^0-9]", "", value) if k in ("card", "phone") else value.lower()))
                    # No word reaches into a base span, so that a place in the order of words parts those before and after.
                    place = int(np.searchsorted(starts, b))
                    terms = hashes[max(0, place - window) : place + window]
                    context = int.from_bytes(hashlib.blake2b(terms.tobytes(), digest_size=8).digest(), "little", signed=True)
                    # A mention without words near it still counts as one of its entity.
                    found |= {(entity, 0, None), *((entity, context, t) for t in terms.tolist())}
                near[i] = [{"entity": e, "context": c, "term": t} for e, c, t in found]
            yield pa.RecordBatch.from_arrays([ids, *counts, pa.array(base, pa.string()), pa.array(secret, pa.string()), pa.array(keys, pa.binary()), pa.array(near, kind)], names)

    return run


def _passing(batches, bits: np.ndarray):
    """(bytes, offsets, documents, starts, ends, terms) of the words outside base spans whose term's bit is set."""
    for batch in batches:
        raw, at = utf8(batch.column(0))
        for _, _, part, offsets in chunks(raw, at):
            starts, ends, terms = _terms(_without_base(part, offsets)[0], offsets)
            keep = np.flatnonzero(bits[(terms.view(np.uint64) >> np.uint64(64 - BITS)).astype(np.int64)])
            if len(keep):
                yield part, offsets, np.searchsorted(offsets, starts[keep], "right") - 1, starts[keep], ends[keep], terms[keep]


def _documents_with(bitmap):
    """(key, term) of the terms whose bit is set, once a text and batch."""

    def run(batches):
        import pyarrow as pa

        for part, offsets, doc, _, _, terms in _passing(batches, bitmap.value):
            order = np.lexsort((terms, doc))
            h, d = terms[order], doc[order]
            once = np.concatenate([[True], (h[1:] != h[:-1]) | (d[1:] != d[:-1])])
            own = {i: _key(part[offsets[i] : offsets[i + 1]]) for i in np.unique(d).tolist()}
            yield pa.RecordBatch.from_arrays([pa.array([own[i] for i in d[once].tolist()], pa.binary()), pa.array(h[once])], ["key", "term"])

    return run


def _occurrences(bitmap):
    """(key, term, start, end) of every word outside base spans whose term's bit is set, in code points."""

    def run(batches):
        import pyarrow as pa

        for part, offsets, doc, starts, ends, terms in _passing(batches, bitmap.value):
            points = _points(part)
            begin = points[offsets[doc]]
            own = {i: _key(part[offsets[i] : offsets[i + 1]]) for i in np.unique(doc).tolist()}
            keys = pa.array([own[i] for i in doc.tolist()], pa.binary())
            yield pa.RecordBatch.from_arrays([keys, pa.array(terms), pa.array(points[starts] - begin), pa.array(points[ends] - begin)], ["key", "term", "start", "end"])

    return run


def _bitmap(terms: DataFrame):
    """The bits of terms, broadcast, or None without terms: at most 2^BITS come to the driver, however many terms there are."""
    set_bits = terms.select(F.shiftrightunsigned("term", 64 - BITS).alias("bit")).distinct().toPandas()["bit"].to_numpy(np.int64)
    bits = np.zeros(1 << BITS, bool)
    bits[set_bits] = True
    return terms.sparkSession.sparkContext.broadcast(bits) if len(set_bits) else None


def find(docs: DataFrame, window: int = WINDOW, support: int = SUPPORT, remove: float = REMOVE, generalise: float = GENERALISE) -> DataFrame:
    """One row per row of docs (doc_id, text): doc_id, n_email, n_ip, n_card, n_phone, base (spans kind:start:end, comma-
    joined), secrets (likewise), terms (array of start, end, action: every word outside both, in any text, whose term
    discloses an entity, removed or generalised). Null and empty texts have no spans; repeated rows are rows of their own,
    but equal texts count once in all statistics; texts of any length are read whole, and words of any length are terms; a
    term that discloses several entities goes by the strongest, and equal strengths act alike; other columns of docs,
    whatever their names, are left out; an empty table gives an empty result."""
    schema = "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base string, secrets string, key binary, near array<struct<entity:long,context:long,term:long>>"
    found = materialise(map_arrow(docs.select("doc_id", "text"), _find(window), schema), "personal")
    # All counts are of distinct texts: copies are no evidence for a term, and none against it.
    total = max(1, found.select("key").distinct().count())
    near = materialise(found.where(F.size("near") > 0).dropDuplicates(["key"]).select("key", F.inline("near")), "near")
    entities = near.where("term is null").groupBy("entity").agg(F.count("*").alias("of_entity"))
    pairs = near.where("term is not null").groupBy("entity", "term").agg(F.count_distinct("context").alias("contexts"), F.count_distinct("key").alias("texts"))
    # A term's documents are at least those that have it near a mention, so that most pairs can't be strong.
    nearby = near.where("term is not null").groupBy("term").agg(F.count_distinct("key").alias("documents"))
    rarity = F.log(F.lit(float(total)) / F.col("of_entity"))
    given = F.col("texts") / F.col("documents")
    strength = F.when(rarity > 0, 1 + F.log(given) / rarity).otherwise(0.0)
    pairs = pairs.where(F.col("contexts") >= support).join(nearby, "term").join(entities, "entity").where(strength >= generalise)
    pairs = materialise(pairs.select("entity", "term", "texts", "of_entity"), "pairs")
    marks = None
    if bitmap := _bitmap(pairs):
        wanted = materialise(pairs.select("term").distinct(), "terms")
        counted = map_arrow(docs.select("text"), _documents_with(bitmap), "key binary, term long").join(fitting(wanted), "term", "left_semi")
        documents = counted.distinct().groupBy("term").agg(F.count("*").alias("documents"))
        strong = pairs.join(documents, "term").groupBy("term").agg(F.max(strength).alias("strength")).where(F.col("strength") >= generalise)
        strong = materialise(strong, "disclosing")
        if bitmap := _bitmap(strong):
            # One more pass marks the terms wherever they stand, in all texts.
            seen = map_arrow(docs.select("text"), _occurrences(bitmap), "key binary, term long, start long, end long")
            action = F.when(F.col("strength") >= remove, "remove").otherwise("generalise").alias("action")
            marks = materialise(seen.join(fitting(strong), "term").select("key", "start", "end", action).distinct(), "marks")
    if marks is not None:
        # Texts alone decide on marks, so that rows of equal texts share theirs.
        terms = marks.groupBy("key").agg(F.array_sort(F.collect_list(F.struct("start", "end", "action"))).alias("terms"))
        small = marks.limit(MARKS + 1).count() <= MARKS
        found = found.join(F.broadcast(terms) if small else terms.hint("shuffle_merge"), "key", "left")
    else:
        found = found.withColumn("terms", F.lit(None).cast("array<struct<start:long,end:long,action:string>>"))
    return found.select("doc_id", "n_email", "n_ip", "n_card", "n_phone", "base", "secrets", F.coalesce("terms", F.array().cast("array<struct<start:long,end:long,action:string>>")).alias("terms"))


def generalised(word: str) -> str:
    """What stays of a generalised term: its kind."""
    return "[NUMBER]" if any(c.isdigit() for c in word) else "[NAME]" if word[:1].isupper() else "[TERM]"


def sanitise(text: str, base: str, terms) -> str:
    """The text without its personal data: spans of base (base spans and secrets, comma-joined) become their kind, terms go or become theirs. Of spans that
    overlap, the one that starts first (then the longer) counts."""
    spans = [(int(a), -int(b), f"[{k.upper()}]") for k, a, b in (s.split(":") for s in base.split(",") if s)]
    spans += [(a, -b, "[REMOVED]" if action == "remove" else generalised(text[a:b])) for a, b, action in terms]
    out, last = [], 0
    for a, b, new in sorted(spans):
        if a >= last:
            out += [text[last:a], new]
            last = -b
    return "".join([*out, text[last:]])


def query(spark, sf_dir: str) -> DataFrame:
    """Beside the contract's columns: n_secret, and n_spans of all kinds."""
    found = find(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    terms = F.array_join(F.transform("terms", lambda t: F.concat_ws(":", F.lit("term"), t["start"], t["end"])), ",")
    spans = F.concat_ws(",", *[F.when(c != "", c) for c in (F.col("base"), F.col("secrets"), terms)])
    counts = [*(f"n_{k}" for k in KINDS), F.regexp_count("secrets", F.lit("secret:")).cast("long").alias("n_secret")]
    every = F.when(spans == "", 0).otherwise(F.regexp_count(spans, F.lit(",")) + 1).cast("long").alias("n_spans")
    return found.select("doc_id", *counts, every, F.sha2(F.col("base").cast("binary"), 256).alias("base_sha256"), spans.alias("spans"))
