"""PII: base patterns, and terms that by corpus co-occurrence disclose a protected entity (DataFrame functions only)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import WORD, apart, row_columns, store
from .simhash import components

_LOCAL = "A-Za-z0-9._%+-"
#: Patterns in Java syntax. They find what the plain ones find, in linear time: a match can only begin where a run of
#: its first class begins (or where the last match ended), and quantifiers that never need to give back are possessive.
#: card takes only the runs whose number of digits is right; such a run is what the plain pattern matches as a whole.
BASE = {
    "email": rf"(?:(?<![{_LOCAL}])|\G)[{_LOCAL}]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:(?<![0-9])|\G)[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"(?<![0-9])(?<![0-9][\x20-])[0-9](?:[\x20-]?[0-9]){15,18}(?![\x20-]?[0-9])",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
TERM = r"[\p{L}\p{N}]+"
#: Least letters of a term; classes of documents that it must share with an entity if it also stands in others; what
#: is added to a term's classes, so that few of them weigh less.
TERM_CHARS, SUPPORT, PRIOR = 3, 3, 0.5
#: Near copies: words of a shingle, least hashes kept of a text, those by which texts meet, and the share they need alike.
SHINGLE, SKETCH, KEYS, ALIKE = 4, 32, 3, 0.5
#: PMI as a share of the entity's information content, from which a term is generalised, and removed.
GENERALISE, REMOVE = 0.80, 0.95

#: What every text with a base span has.
MARK = r"@|[0-9]\.[0-9]|\+[0-9]|[0-9](?:[\x20-]?[0-9]){15}"
_SPAN = "array<struct<kind:string,start:int,end:int,value:string>>"
_PART = "array<struct<at:int,part:array<struct<p:string,v:string>>>>"
#: Matches whose places are added up in one fold.
FOLD = 128


def matches(text: Column, pattern: Column, kind: str) -> Column:
    """All matches with places in code points (end exclusive): places add up from the pieces between the matches.

    Spans of FOLD matches are made at a time, from where the matches before them end, so that the work grows with the
    matches and not with their square.
    """
    found = F.regexp_extract_all(text, pattern, F.lit(0))
    pieces = F.split(text, pattern, -1)
    pairs = F.zip_with(F.slice(pieces, 1, F.size(found)), found, lambda p, v: F.struct(p.alias("p"), v.alias("v")))

    def begin(at: Column, items: Column) -> Column:
        return F.struct(at.cast("int").alias("at"), items.alias("items"))

    def add(acc: Column, x: Column) -> Column:
        start = acc["at"] + F.length(x["p"])
        end = start + F.length(x["v"])
        span = F.struct(F.lit(kind).alias("kind"), start.alias("start"), end.alias("end"), x["v"].alias("value"))
        return begin(end, F.concat(acc["items"], F.array(span)))

    def fold(at: Column, some: Column) -> Column:
        return F.aggregate(some, begin(at, F.array().cast(_SPAN)), add, lambda acc: acc["items"])

    width = lambda part: F.aggregate(part, F.lit(0), lambda a, x: a + F.length(x["p"]) + F.length(x["v"]))
    put = lambda acc, part: begin(acc["at"] + width(part), F.concat(acc["items"], F.array(F.struct(acc["at"].alias("at"), part.alias("part")))))

    def in_parts(all_pairs: Column) -> Column:
        parts = F.transform(F.sequence(F.lit(0), F.floor((F.size(all_pairs) - 1) / FOLD).cast("int")), lambda c: F.slice(all_pairs, c * FOLD + 1, FOLD))
        starts = F.aggregate(parts, begin(F.lit(0), F.array().cast(_PART)), put, lambda acc: acc["items"])
        return F.flatten(F.transform(starts, lambda s: fold(s["at"], s["part"])))

    many = F.transform(F.array(pairs), in_parts)[0]  # a lambda's variable is made once
    return F.when(F.size(found) > FOLD, many).when(F.size(found) > 0, fold(F.lit(0), pairs)).otherwise(F.array().cast(_SPAN))


def _luhn(value: Column) -> Column:
    digits = F.reverse(F.translate(value, " -", ""))
    at = F.sequence(F.lit(1), F.length(digits))

    def weigh(i: Column) -> Column:
        d = F.substr(digits, i, F.lit(1)).cast("int") * (2 - i % 2)
        return F.when(d > 9, d - 9).otherwise(d)

    return F.aggregate(at, F.lit(0), lambda a, i: a + weigh(i)) % 10 == 0


def _valid(kind: str, value: Column) -> Column:
    if kind == "ip":  # long digit runs exceed 255 whatever they are, unless their head is zeros
        return F.forall(F.split(value, r"\."), lambda p: F.length(F.ltrim(p, F.lit("0"))) <= F.lit(3)) & F.forall(F.split(value, r"\."), lambda p: F.coalesce(F.substring(F.ltrim(p, F.lit("0")), 1, 4).try_cast("int"), F.lit(0)) <= 255)
    if kind == "card":
        return _luhn(value)
    if kind == "phone":
        return F.length(F.regexp_replace(value, "[^0-9]", "")).between(8, 15)
    return F.lit(True)


def _checked(kind: str, spans: Column) -> Column:
    return F.filter(spans, lambda s: _valid(kind, s["value"]))


def base_spans(text: Column) -> Column:
    """Spans of the four base kinds, in that order and then by start. Texts without a kind's mark skip its pattern."""
    text = F.coalesce(text, F.lit(""))
    mark = {"email": F.contains(text, F.lit("@")), "ip": text.rlike(r"[0-9]\.[0-9]"), "card": text.rlike(r"[0-9](?:[\x20-]?[0-9]){15}"), "phone": text.rlike(r"\+[0-9]")}
    out = []
    for kind, pattern in BASE.items():
        found = _checked(kind, matches(text, F.lit(pattern), kind))
        out.append(F.when(mark[kind], found).otherwise(F.array().cast(_SPAN)))
    return F.concat(*out)


def near_classes(docs: DataFrame) -> DataFrame:
    """h (hash of the text), c (class of its near copies), rows of each distinct text; null texts have no class.

    A text is known by the SKETCH least hashes of its shingles. Texts that share one of the KEYS least meet the first of
    them, and are linked if ALIKE of both sketches is the same; a class is what links connect.
    """
    words = F.regexp_extract_all(F.lower("text"), F.lit(WORD), F.lit(0))
    hashed = F.transform(F.sequence(F.lit(1), F.greatest(F.size("w") - (SHINGLE - 1), F.lit(1))), lambda i: F.xxhash64(F.slice("w", i, SHINGLE)))
    each = docs.where(F.col("text").isNotNull()).select(F.xxhash64("text").alias("h"), words.alias("w"))
    each = each.select("h", F.slice(F.array_sort(F.array_distinct(hashed)), 1, SKETCH).alias("sketch"))
    each = store(each.groupBy("h").agg(F.first("sketch").alias("sketch"), F.count("*").alias("rows")), "pii-sketches")
    n = each.count()
    keys = each.select("h", F.explode(F.slice("sketch", 1, KEYS)).alias("key"))
    first = keys.groupBy("key").agg(F.min("h").alias("b"), F.count("*").alias("n")).where("n > 1")
    met = keys.join(first, "key").where("h <> b").select(F.col("h").alias("a"), "b").distinct()
    met = met.join(each.select(F.col("h").alias("a"), F.col("sketch").alias("x")), "a").join(each.select(F.col("h").alias("b"), F.col("sketch").alias("y")), "b")
    linked = store(met.where(F.size(F.array_intersect("x", "y")) >= ALIKE * F.size(F.array_union("x", "y"))).select("a", "b"), "pii-links", n)
    classes = each.select("h", "rows").join(components(linked), F.col("h") == F.col("node"), "left")
    return store(classes.select("h", F.coalesce("root", "h").alias("c"), "rows"), "pii-classes", n)


def _words(c: Column) -> Column:
    return F.filter(F.regexp_extract_all(F.lower(c), F.lit(TERM), F.lit(0)), lambda t: F.length(t) >= TERM_CHARS)


def disclosing_terms(docs: DataFrame, entities: DataFrame) -> DataFrame:
    """(entity, term, risk) for terms that disclose a protected entity.

    An entity is the value of a base span. All counts are of classes of near copies (near_classes): those that hold the
    entity (n_e), a document with the entity and the term anywhere in it (n_et), the term (n_t), and all. Risk is
    PMI(entity, term) over the entity's information content, with n_et / (n_t + PRIOR) as the share of the term's
    classes that hold the entity. Pairs in fewer than SUPPORT classes are weighed if the term stands in no other class.
    entities: doc_id, text, values (distinct base values of the text), for documents that have any.
    """
    near = near_classes(docs)
    texts = entities.select(F.xxhash64("text").alias("h"), "values", F.array_distinct(_words(F.col("text"))).alias("terms")).dropDuplicates(["h"]).join(near, "h")
    texts = store(texts, "pii-texts")
    held = texts.select("c", "terms", F.explode("values").alias("entity")).select("c", "entity", F.explode("terms").alias("term"))
    n_e = texts.select("c", F.explode("values").alias("entity")).groupBy("entity").agg(F.count_distinct("c").alias("n_e"))
    n_et = held.groupBy("entity", "term").agg(F.count_distinct("c").alias("n_et"))
    total = near.agg(F.count_distinct("c").alias("n")).first()["n"]

    def risk(n_t: Column) -> Column:
        ic = F.log(F.lit(float(total)) / F.col("n_e"))
        return F.when(ic > 0, F.least(F.lit(1.0), F.log(F.col("n_et") * F.lit(float(total)) / (F.col("n_e") * (n_t + PRIOR))) / ic))

    # the classes of documents with entities bound a term's risk before the corpus is read
    sizes = near.groupBy("c").agg(F.sum("rows").alias("rows"))
    known = texts.select("c", "rows", F.explode("terms").alias("term")).groupBy("c", "term").agg(F.sum("rows").alias("known")).join(sizes, "c")
    known = known.groupBy("term").agg(F.count("*").alias("n_known"), F.sum("known").alias("known"), F.sum("rows").alias("most"))
    pairs = n_et.join(known, "term").where((F.col("n_et") >= SUPPORT) | (F.col("n_et") == F.col("n_known"))).join(n_e, "entity")
    pairs = store(pairs.where(risk(F.col("n_known")) >= GENERALISE), "pii-pairs")
    n = pairs.count()
    if not n:
        return pairs.select("entity", "term", F.lit(0.0).alias("risk"))
    # a term of more rows than these classes have stands in another class too
    corpus = docs.where(F.col("text").isNotNull()).select(F.xxhash64("text").alias("h"), F.explode(F.array_distinct(_words(F.col("text")))).alias("term"))
    pairs = pairs.join(corpus.groupBy("term").agg(F.count("*").alias("n_rows")), "term").where((F.col("n_et") >= SUPPORT) | (F.col("n_rows") <= F.col("most")))
    pairs = store(pairs, "pii-candidates", n)
    # other rows' classes are counted only for terms that stand in rows without entities
    open_terms = store(pairs.where(F.col("n_rows") > F.col("known")).select("term").distinct(), "pii-open", n)
    spelled = corpus.join(open_terms, "term", "left_semi").distinct()
    n_t = spelled.join(near, "h").groupBy("term").agg(F.count_distinct("c").alias("n_t"))
    pairs = pairs.join(n_t, "term", "left").withColumn("n_t", F.coalesce("n_t", "n_known")).where((F.col("n_et") >= SUPPORT) | (F.col("n_et") == F.col("n_t")))
    return pairs.select("entity", "term", risk(F.col("n_t")).alias("risk")).where(F.col("risk") >= GENERALISE)


def terms_by_document(docs: DataFrame) -> DataFrame:
    """(_id, _key, terms, removed): for each document the terms that disclose an entity the document itself holds."""
    values = lambda spans: F.array_distinct(F.transform(spans, lambda s: s["value"]))
    held = store(
        docs.where(F.col("text").rlike(MARK))
        .select("doc_id", "text", values(base_spans(F.col("text"))).alias("values")).where(F.size("values") > 0),
        "pii-held",
    )
    n = held.count()
    risky = store(disclosing_terms(docs, held), "pii-risky", n)
    own = held.select("doc_id", F.xxhash64("text").alias("_key"), "values", F.explode(F.array_distinct(_words(F.col("text")))).alias("term"))
    own = own.select("doc_id", "_key", "term", F.explode("values").alias("entity")).join(risky, ["entity", "term"])
    own = own.groupBy("doc_id", "_key").agg(F.array_sort(F.collect_set("term")).alias("terms"), F.array_sort(F.collect_set(F.when(F.col("risk") >= REMOVE, F.col("term")))).alias("removed"))
    return store(own.withColumnsRenamed({"doc_id": "_id"}), "pii-terms", n)


def _term_spans(text: Column, terms: Column) -> Column:
    pattern = F.concat(F.lit(r"(?iu)(?<![\p{L}\p{N}])(?:"), F.array_join(terms, "|"), F.lit(r")(?![\p{L}\p{N}])"))
    return F.when(F.size(terms) > 0, matches(text, pattern, "term")).otherwise(F.array().cast(_SPAN))


def _spanned(docs: DataFrame) -> DataFrame:
    """_row, text, spans, removed of each row of `docs`."""
    by_doc = terms_by_document(docs.select("doc_id", "text"))
    rows = apart(docs, "doc_id", "text", base_spans(F.col("text")).alias("_base"))
    none = F.array().cast("array<string>")
    if by_doc.isEmpty():
        return rows.select("_row", "text", F.col("_base").alias("spans"), none.alias("removed"))
    marked = F.coalesce(F.col("text").rlike(MARK), F.lit(False))
    others = rows.where(~marked).select("_row", "text", F.col("_base").alias("spans"), none.alias("removed"))
    rows = rows.where(marked).join(by_doc, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.xxhash64("text") == F.col("_key")), "left")
    terms = _term_spans(F.coalesce("text", F.lit("")), F.coalesce("terms", none))
    outside = F.filter(terms, lambda t: ~F.exists("_base", lambda b: (b["start"] < t["end"]) & (t["start"] < b["end"])))
    return rows.select("_row", "text", F.concat("_base", outside).alias("spans"), F.coalesce("removed", none).alias("removed")).union(others)


def with_spans(docs: DataFrame) -> DataFrame:
    """Adds `spans` (kind, start, end, value; base kinds, then terms outside base spans) and `removed` to each row.

    Null text has no spans. Rows keep their columns; own columns named spans or removed are replaced. Repeated rows
    get equal spans; an empty table gives no rows; texts of any length are searched whole. The table of risky documents is joined only if there are any, on (doc_id, hash of the text), to
    the rows that may hold an entity.
    """
    docs = docs.drop("spans", "removed")
    return _spanned(docs).select(*row_columns(docs), "spans", "removed")


def _join_spans(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def digest(docs: DataFrame) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans (as a string), n_term of each row of `docs`, as
    with_spans() finds them."""
    found = with_spans(docs.select("doc_id", "text"))
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    base = F.filter("spans", lambda s: s["kind"] != "term")
    return found.select("doc_id", *[count(k) for k in (*BASE, "term")], F.sha2(_join_spans(base), 256).alias("base_sha256"), _join_spans(F.col("spans")).alias("spans"))


def sanitise(docs: DataFrame) -> DataFrame:
    """`docs` with text rewritten: a base span becomes <KIND>, a term <TERM> or nothing; n_chars follows if present.

    Overlapping spans are replaced as one, by the mark of the first. Rows without spans keep their text as it is, null
    and empty ones too; repeated rows stay rows; an empty table gives no rows; other columns pass through.
    """
    found = _spanned(docs)
    text = F.coalesce("text", F.lit(""))
    ordered = F.array_sort("spans", lambda a, b: F.when(a["start"] != b["start"], a["start"] - b["start"]).otherwise(b["end"] - a["end"]))
    begin = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("out"))

    def put(acc: Column, s: Column) -> Column:
        mark = F.when(s["kind"] != "term", F.concat(F.lit("<"), F.upper(s["kind"]), F.lit(">"))).when(F.array_contains(F.col("removed"), F.lower(s["value"])), F.lit("")).otherwise(F.lit("<TERM>"))
        more = F.concat(acc["out"], F.array(F.substr(text, acc["at"] + 1, s["start"] - acc["at"]), mark))
        return F.struct(F.greatest(acc["at"], s["end"]).alias("at"), F.when(s["start"] < acc["at"], acc["out"]).otherwise(more).alias("out"))

    rest = lambda acc: F.concat(F.array_join(acc["out"], ""), F.substr(text, acc["at"] + 1, F.length(text) - acc["at"]))
    clean = F.when(F.size("spans") > 0, F.aggregate(ordered, begin, put, rest)).otherwise(F.col("text"))
    found = found.select("_row", "spans", clean.alias("_clean"))
    new = {"text": F.col("_clean")}
    if "n_chars" in docs.columns:
        new["n_chars"] = F.when(F.size("spans") > 0, F.length("_clean").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("_row.n_chars"))
    return found.select(*[new[c].alias(c) if c in new else column for c, column in zip(docs.columns, row_columns(docs))])
