"""Personal data: base patterns and credentials, then information-theoretic sanitisation.

Base spans are found by leftmost non-overlapping patterns per kind (start guards and possessive loops only keep them linear;
they match what the plain patterns match). Credentials (kind ``secret``) are long unbroken runs of letters and digits that carry
much information: at least ``SECRET_DISTINCT`` different characters, some of them letters and some digits.

Other terms can give these away. The corpus says how much: events are documents (equal texts are one event), the protected
entities are the single values (an address, a number, a key) and the kinds. A term t reveals an entity c when
PMI(t; c) = log(p(c|t) / p(c)) reaches ``DISCLOSURE`` of c's information content -log p(c), with t and c counted over whole
documents, and at least ``SUPPORT`` events hold both. p(c|t) is the lower end of its Wilson interval (``Z`` deviations), so that a
rare term has to be seen with c more purely than a common one. Terms that reveal an entity or a kind become spans of kind
``term`` wherever they stand; ``sanitised`` generalises protected spans to the name of their kind and removes such terms.

Only DataFrame and SQL functions are used. Term counts, overall and with each kind, come from one aggregate over the corpus,
pre-aggregated in each task. Values are paired only with terms that are rare enough to reveal them, in documents that hold both;
values of fewer than ``SUPPORT`` events take no part. Of the values, and of the terms, that stand in the same set of documents one
is paired for all, so that a long list of addresses is not paired with itself. Places in a text come from sums of lengths, and its
parts are joined once, so time grows with a text's length however many spans it has.

Defined results: a null or empty text has no spans; positions are code points, ends exclusive; spans of different kinds may
overlap; repeated rows get equal spans; an empty table gives an empty table; ids may be null.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from admeridian.llm.common import staged, text_or_empty

#: The base kinds come first; a kind's place is its number in spans.
KINDS = ("email", "ip", "card", "phone", "secret", "term")
BASE, SECRET, TERM_KIND = 4, KINDS.index("secret"), KINDS.index("term")
#: Share of an entity's information that a term must carry; events that must hold both; deviations of the interval of p(c|t).
DISCLOSURE, SUPPORT, Z = 0.9, 3, 2.0
#: Different characters, letters and digits that a credential has at least.
SECRET_DISTINCT, SECRET_LETTERS, SECRET_DIGITS = 10, 3, 3

#: Code points of a block in which a place of a long text is found.
BLOCK = 1024

#: The base patterns, each with a guard that lets a match start only where a run starts or the last match ended.
PATTERNS = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:(?<![0-9])|\G)[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[ -]?[0-9])++",
    "phone": r"\+[0-9][ ().0-9-]+[0-9]",
    "secret": r"(?<![A-Za-z0-9_])[A-Za-z0-9_]{20,}+",
}
TERM = r"\p{L}{3,}"


def _let(value: Column, of) -> Column:
    """``of`` a value that is worked out once, however often ``of`` reads it and in whatever inner function."""
    return F.element_at(F.transform(F.array(value), of), 1)


def _scan(values: Column, op) -> Column:
    """``op`` of each number of an array with all before it, in steps of doubling width: no array is grown in a fold."""

    def wider(so_far: Column, k: Column) -> Column:
        width = F.call_function("shiftleft", F.lit(1), k)
        earlier = F.concat(F.array_repeat(F.lit(0), width), F.slice(so_far, F.lit(1), F.size(so_far) - width))
        return F.zip_with(so_far, earlier, op)

    def scanned(own: Column) -> Column:
        steps = F.sequence(F.lit(0), F.length(F.bin(F.size(own) - 1)) - 1)
        return F.when(F.size(own) > 1, F.aggregate(steps, own, wider)).otherwise(own)

    return _let(values, scanned)


def _spans(text: Column, pattern: str) -> Column:
    """array<start, end, hit> of all matches: the lengths of the pieces between matches, summed up, give their places."""
    none = F.expr("array_repeat(named_struct('start', 0, 'end', 0, 'hit', ''), 0)")

    def placed(own: Column) -> Column:
        steps = F.zip_with(F.slice(own["pieces"], F.lit(1), F.size(own["hits"])), own["hits"], lambda piece, hit: F.length(piece) + F.length(hit))
        return F.zip_with(_scan(steps, lambda x, y: x + y), own["hits"], lambda end, hit: F.struct((end - F.length(hit)).alias("start"), end.alias("end"), hit.alias("hit")))

    found = F.struct(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("hits"), F.split(text, pattern, -1).alias("pieces"))
    return F.when(F.rlike(text, F.lit(pattern)), _let(found, placed)).otherwise(none)


def _luhn(digits: Column) -> Column:
    n = F.length(digits)

    def add(total: Column, i: Column) -> Column:
        d = F.substring(digits, n - i, F.lit(1)).cast("int")
        twice = F.when(d > 4, 2 * d - 9).otherwise(2 * d)
        return total + F.when(i % 2 == 1, twice).otherwise(d)

    return F.aggregate(F.sequence(F.lit(0), n - 1), F.lit(0), add) % 10 == 0


def _valid(kind: str, hit: Column) -> Column:
    if kind == "ip":
        part = lambda x: F.regexp_replace(x, "^0+", "")
        return F.forall(F.split(hit, r"\."), lambda x: (F.length(part(x)) < 3) | ((F.length(part(x)) == 3) & (part(x) <= "255")))
    digits = F.regexp_replace(hit, "[^0-9]", "")
    n = F.length(digits)
    if kind == "secret":
        mixed = (n >= SECRET_DIGITS) & (F.length(F.regexp_replace(hit, "[^A-Za-z]", "")) >= SECRET_LETTERS)
        return F.when(mixed, F.size(F.array_distinct(F.split(hit, ""))) >= SECRET_DISTINCT).otherwise(False)
    if kind == "card":
        return F.when((n >= 12) & (n <= 19), _luhn(digits)).otherwise(False)
    return (n >= 9) & (n <= 15) if kind == "phone" else F.lit(True)


def protected_values(text: Column) -> Column:
    """array<start, kind, end, entity> of base spans and credentials, by start, then kind; ``kind`` is a place in ``KINDS``,
    ``entity`` a number for the span's value: letters in one case, cards and phones by their digits."""

    def of(i: int, kind: str) -> Column:
        kept = F.filter(_spans(text, PATTERNS[kind]), lambda s: _valid(kind, s["hit"]))
        value = (lambda hit: F.regexp_replace(hit, "[^0-9]", "")) if kind in ("card", "phone") else F.lower
        return F.transform(kept, lambda s: F.struct(s["start"].alias("start"), F.lit(i).alias("kind"), s["end"].alias("end"), F.xxhash64(F.lit(i), value(s["hit"])).alias("entity")))

    return F.array_sort(F.concat(*[of(i, kind) for i, kind in enumerate(KINDS[:TERM_KIND])]))


def places(values: Column) -> Column:
    return F.transform(values, lambda s: F.struct(s["start"].alias("start"), s["kind"].alias("kind"), s["end"].alias("end")))


def _joined(text: Column, spans: Column, part) -> Column:
    """The text with ``part(span, before, piece)`` for each span, in order: ``before`` is the end of all spans before it, and
    ``piece(a, b)`` the text from a to b, found by blocks, as a place in a long string takes time to find."""

    def piece(blocks: Column, a: Column, b: Column) -> Column:
        first = F.floor(a / BLOCK).cast("int")
        some = F.slice(blocks, first + 1, F.floor((b - 1) / BLOCK).cast("int") - first + 1)
        return F.when(b > a, F.substring(F.array_join(some, ""), a - first * BLOCK + 1, b - a)).otherwise("")

    def whole(own: Column) -> Column:
        before = F.concat(F.array(F.lit(0)), F.slice(own["reached"], F.lit(1), F.size(own["spans"]) - 1))
        parts = F.zip_with(own["spans"], before, lambda s, at: part(s, at, lambda a, b: piece(own["blocks"], a, b)))
        return F.concat(F.array_join(parts, ""), piece(own["blocks"], F.element_at(own["reached"], -1), own["length"]))

    reached = _scan(F.transform(spans, lambda s: s["end"]), lambda x, y: F.greatest(x, y))
    known = F.struct(spans.alias("spans"), reached.alias("reached"), F.regexp_extract_all(text, F.lit(f"(?s).{{1,{BLOCK}}}"), F.lit(0)).alias("blocks"), F.length(text).alias("length"))
    return F.when(F.size(spans) > 0, _let(known, whole)).otherwise(text)


def _outside(text: Column, spans: Column) -> Column:
    """The text with blanks in place of its protected spans, so that every other character keeps its place."""

    def part(s: Column, before: Column, piece) -> Column:
        blank = F.repeat(F.lit(" "), F.greatest(F.lit(0), s["end"] - F.greatest(s["start"], before)))
        return F.concat(piece(before, s["start"]), blank)

    return _joined(text, spans, part)


def _terms(text: Column) -> Column:
    """The distinct terms in lower case. Where lower-casing keeps the length of a text it is done once for the whole of it."""
    whole = F.lower(text)
    words = lambda t: F.regexp_extract_all(t, F.lit(TERM), F.lit(0))
    return F.array_distinct(F.when(F.length(whole) == F.length(text), words(whole)).otherwise(F.transform(words(text), F.lower)))


def event_key(text: Column) -> Column:
    """128 bits of a text."""
    return F.struct(F.xxhash64(text).alias("a"), F.xxhash64(F.lit(1), text).alias("b"))


def _discloses(n_pair: Column, n_term: Column, n_entity: Column, n_events: Column, disclosure: float, z: float) -> Column:
    """PMI against the entity's information content; p(c|t) at the lower end of its Wilson interval."""
    p, n, zz = n_pair / n_term, n_term.cast("double"), z * z
    low = (p + zz / (2 * n) - z * F.sqrt(p * (1 - p) / n + zz / (4 * n * n))) / (1 + zz / n)
    prior = n_entity / n_events
    return F.log(low) - F.log(prior) >= disclosure * -F.log(prior)


DOCUMENTS = ("docs_a", "docs_b")


def _documents() -> list[Column]:
    """128 bits of the set of documents of a group."""
    return [F.bit_xor(F.xxhash64(F.lit(i), "row")).alias(name) for i, name in enumerate(DOCUMENTS)]


def revealing_terms(found: DataFrame, disclosure: float = DISCLOSURE, support: int = SUPPORT, z: float = Z) -> DataFrame:
    """(term) of the terms that reveal an entity or a kind. ``found``: row, event, kinds, entities, terms."""
    again = staged(found.groupBy("event").agg(F.min("row").alias("least"), F.count("*").alias("times")).filter("times > 1").select("event", "least"), "repeated")
    events = found.join(again, "event", "left").filter("least IS NULL OR least = row").drop("event", "least")
    has = [F.array_contains("kinds", i).cast("long").alias(f"k{i}") for i in range(TERM_KIND)]
    # one event, the document, for all counts; each task sends a term once
    words = events.select("row", *has, F.explode("terms").alias("term"))
    counts = words.groupBy("term").agg(F.count("*").alias("n_term"), *_documents(), *[F.sum(f"k{i}").alias(f"k{i}") for i in range(TERM_KIND)]).filter(F.col("n_term") >= support)
    counts = staged(counts, "terms")
    total = staged(events.agg(F.count("*").alias("n_events"), *[F.coalesce(F.sum(h), F.lit(0)).alias(f"all_k{i}") for i, h in enumerate(has)]), "kinds")  # one row
    pairs = F.array(*[F.struct(F.col(f"k{i}").alias("n_pair"), F.col(f"all_k{i}").alias("n_entity")) for i in range(TERM_KIND)])
    by_kind = counts.crossJoin(F.broadcast(total)).select("term", "n_term", "n_events", F.explode(pairs).alias("p")).select("term", "n_term", "n_events", "p.*")

    held = events.filter(F.size("entities") > 0).select("row", "entities", "terms")
    values = held.select("row", F.explode("entities").alias("entity"))
    often = values.groupBy("entity").agg(F.count("*").alias("n_entity"), *_documents()).filter(F.col("n_entity") >= support)
    # values that stand in the same documents are revealed alike, and terms that do reveal alike: one of each such group is paired
    often = often.groupBy("n_entity", *DOCUMENTS).agg(F.min("entity").alias("entity")).drop(*DOCUMENTS)
    values = staged(values.join(often, "entity"), "values")
    # p(c|t) is at most n_entity / n_term: commoner terms cannot reach the threshold
    most = lambda n, of: F.pow(n, F.lit(disclosure)) * F.pow(of, F.lit(1 - disclosure))
    bound = values.agg(F.coalesce(F.max("n_entity"), F.lit(0)).alias("largest"))
    alike = staged(counts.groupBy("n_term", *DOCUMENTS).agg(F.min("term").alias("term")).drop(*DOCUMENTS), "alike")
    rare = alike.crossJoin(F.broadcast(total.select("n_events"))).crossJoin(F.broadcast(bound)).filter(F.col("n_term") <= most(F.col("largest"), F.col("n_events")))
    near = held.join(values.select("row").distinct(), "row", "left_semi").select("row", F.explode("terms").alias("term")).join(rare, "term")
    both = near.join(values, "row").filter(F.col("n_term") <= most(F.col("n_entity"), F.col("n_events")))
    by_value = both.groupBy("term", "entity", "n_term", "n_entity", "n_events").agg(F.count("*").alias("n_pair"))

    columns = ["term", "n_term", "n_events", "n_pair", "n_entity"]
    scored = by_kind.select(*columns).unionByName(by_value.select(*columns)).filter(F.col("n_pair") >= support)
    reveals = scored.filter(_discloses(F.col("n_pair"), F.col("n_term"), F.col("n_entity"), F.col("n_events"), disclosure, z)).select("term").distinct()
    group = counts.join(reveals, "term").select("n_term", *DOCUMENTS).distinct()
    return counts.join(group, ["n_term", *DOCUMENTS], "left_semi").select("term")


def find_personal_data(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", disclosure: float = DISCLOSURE, support: int = SUPPORT, z: float = Z, with_text: bool = False) -> DataFrame:
    """One row per row: ``doc_id, spans`` (array<start, kind, end> of all kinds) and, if asked for, ``text``."""
    texts = docs.select(F.col(id_col).alias("doc_id"), text_or_empty(F.col(text_col)).alias("text")).withColumns({"event": event_key(F.col("text")), "values": protected_values(F.col("text"))}).withColumn("spans", places(F.col("values")))
    # what is counted of each text; the table fixes the row numbers, whole texts are read again rather than written
    counted = texts.select("event", F.array_distinct(F.transform("spans", lambda s: s["kind"])).alias("kinds"), F.array_distinct(F.transform("values", lambda s: s["entity"])).alias("entities"), _terms(_outside(F.col("text"), F.col("spans"))).alias("terms"))
    counted = staged(counted.withColumn("row", F.monotonically_increasing_id()), "personal")
    revealing = staged(revealing_terms(counted, disclosure, support, z), "revealing")
    shown = counted.select("event", "row", F.explode("terms").alias("term")).join(revealing, "term").groupBy("event", "row").agg(F.collect_set("term").alias("shown"))
    shown = staged(shown.groupBy("event").agg(F.first("shown").alias("shown")), "shown")  # equal texts show equal terms
    found = texts.join(shown, "event", "left")
    shown_at = F.filter(_spans(_outside(F.col("text"), F.col("spans")), TERM), lambda s: F.array_contains("shown", F.lower(s["hit"])))
    more = F.transform(shown_at, lambda s: F.struct(s["start"].alias("start"), F.lit(TERM_KIND).alias("kind"), s["end"].alias("end")))
    spans = F.when(F.col("shown").isNull(), F.col("spans")).otherwise(F.array_sort(F.concat("spans", more)))
    return found.select("doc_id", spans.alias("spans"), *(["text"] if with_text else []))


def described(spans: Column) -> Column:
    """``kind:start:end`` of all spans, comma-joined."""
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.element_at(names, s["kind"] + 1), s["start"].cast("string"), s["end"].cast("string"))), ",")


def personal_data_digest(docs: DataFrame, **options) -> DataFrame:
    """``doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_secret, n_term, n_spans``."""
    found = find_personal_data(docs, **options)
    of = lambda i: F.size(F.filter("spans", lambda s: s["kind"] == i)).cast("long")
    count = {k: of(i).alias(f"n_{k}") for i, k in enumerate(KINDS)}
    base = F.filter("spans", lambda s: s["kind"] < BASE)
    return found.select("doc_id", *[count[k] for k in KINDS[:BASE]], F.sha2(described(base), 256).alias("base_sha256"), described(F.col("spans")).alias("spans"), *[count[k] for k in KINDS[BASE:]], F.size("spans").cast("long").alias("n_spans"))


def sanitised(docs: DataFrame, **options) -> DataFrame:
    """``doc_id, text``: protected spans become ``[KIND]``, revealing terms go; spans that overlap become one, named by the first."""
    found = find_personal_data(docs, with_text=True, **options)
    names = F.array(*[F.lit(f"[{k.upper()}]") for k in KINDS[:TERM_KIND]], F.lit(""))

    def part(s: Column, before: Column, piece) -> Column:
        return F.when(s["start"] >= before, F.concat(piece(before, s["start"]), F.element_at(names, s["kind"] + 1))).otherwise("")

    return found.select("doc_id", _joined(F.col("text"), F.col("spans"), part).alias("text"))
