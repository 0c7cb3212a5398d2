import hashlib
import math
import re
from collections import defaultdict

import regex
from pyspark.sql import functions as F

from rankfile.llm import pii, queries, urlfilter

from .fixtures import awkward, empty, same, table

PLAIN = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(digits):
    return sum(sum(divmod(int(c) * (1 + i % 2), 10)) for i, c in enumerate(reversed(digits))) % 10 == 0


def brute(text):
    out = []
    for kind, pattern in PLAIN.items():
        for m in re.finditer(pattern, text or ""):
            digits = re.sub("[^0-9]", "", m.group())
            if kind == "ip" and any(int(x) > 255 for x in m.group().split(".")):
                continue
            if kind == "card" and not (16 <= len(digits) <= 19 and luhn(digits)):
                continue
            if kind == "phone" and not 8 <= len(digits) <= 15:
                continue
            out.append((kind, m.start(), m.end()))
    return out


def test_base_spans(spark):
    odd = ["a@b.c_d@e.f", "x@y..z q@w.e", "1.2.3.4.5.6.7.8", "256.1.1.1.1", "4111-1111-1111-1111 4111 1111  1111 1111", "41111111111111111111 1", "+1+2 3456789", "++12345678)9", "\U0001d49c a@b.cd \U0001d49c 9.9.9.9", "0000000000000000000", "00000255.1.1.1", "+1" + "2" * 14, "a" * 5000 + "@", "1" * 5000, "4 1 1 1 1 1 1 1 1 1 1 1 1 1 1 1", "." * 2000 + "@a.b"]
    docs = spark.createDataFrame(list(enumerate(odd)), "doc_id long, text string")
    for frame in (docs, awkward(spark), table(spark, "documents", "/root/testdata/sf0.01")):
        got = pii.digest(frame).collect()
        want = []
        for r in frame.select("doc_id", "text").collect():
            spans = brute(r["text"])
            n = [sum(s[0] == k for s in spans) for k in PLAIN]
            want.append((r["doc_id"], *n, hashlib.sha256(",".join(f"{k}:{a}:{b}" for k, a, b in spans).encode()).hexdigest()))
        same([(r["doc_id"], r["n_email"], r["n_ip"], r["n_card"], r["n_phone"], r["base_sha256"]) for r in got], want)
        for r in got:
            assert not r["spans"] or all(re.fullmatch(r"(email|ip|card|phone|term):\d+:\d+", s) for s in r["spans"].split(","))
    assert pii.digest(empty(spark)).count() == 0


def test_terms_that_disclose_an_entity_go(spark):
    filler = [f"quiet line number {i} about nothing much" for i in range(60)]
    rows = [(i, f"{filler[i]}\nWrite to Zebulon the clerk name{i} at zeb@x.org today\n{filler[i + 20]}") for i in range(6)]
    rows += [(10 + i, f"the clerk said {filler[i]} today") for i in range(50)] + [(99, "Zebulon again, but no address"), (98, None), (97, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    clean = {r["doc_id"]: r["text"] for r in pii.sanitise(docs).collect()}
    for i in range(6):
        assert "zeb@x.org" not in clean[i] and "<EMAIL>" in clean[i] and "Zebulon" not in clean[i]
        assert filler[i] in clean[i] and "the clerk" in clean[i] and "today" in clean[i]
    assert {i: clean[i] for i in clean if i >= 10} == {r[0]: r[1] for r in rows if r[0] >= 10}


def test_terms_are_weighed_by_classes_of_documents(spark):
    filler = [f"quiet line number {i} about nothing much" for i in range(60)]
    rows = [(i, f"{filler[i]}\nWrite to Zebulon the clerk {i} at zeb@x.org today\n{filler[i + 20]}") for i in range(6)]
    rows += [(10 + i, f"the clerk said {filler[i]} today") for i in range(50)]
    rows += [(70, "ask Quillon about the clerk at quil@x.org today"), (71, "ask Ostrander the clerk at ost@x.org"), (72, "Ostrander is heard of elsewhere too")]
    story = " ".join(f"word{k} of a long tale" for k in range(40))
    rows += [(80 + i, f"{story} by the clerk Vandermeer at van@x.org copy{i}") for i in range(4)]  # near copies: one class
    rows += [(90, f"{story} by the clerk Vandermeer")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    clean = {r["doc_id"]: r["text"] for r in pii.sanitise(docs).collect()}
    for i in range(6):  # windows that are alike in distinct documents are evidence
        assert "<EMAIL>" in clean[i] and "Zebulon" not in clean[i] and filler[i] in clean[i] and "the clerk" in clean[i]
    assert "Quillon" not in clean[70] and "about the clerk" in clean[70]  # one document, but the term stands in no other
    assert "Ostrander the clerk" in clean[71] and clean[72] == rows[58][1]
    assert all("Vandermeer" not in clean[80 + i] for i in range(4)) and "Vandermeer" in clean[90]
    classes = {r["h"]: r["c"] for r in pii.near_classes(docs).collect()}
    of = dict(docs.selectExpr("doc_id", "xxhash64(text)").collect())
    assert len({classes[of[k]] for k in (80, 81, 82, 83, 90)}) == 1 and len(set(classes.values())) == len(rows) - 4


def plain_risks(docs):
    """Risks by (entity, term), from counts of classes in plain Python over all rows of `docs`."""
    class_of = {r["h"]: r["c"] for r in pii.near_classes(docs).collect()}
    holds, spelled, together = defaultdict(set), defaultdict(set), defaultdict(set)
    for r in docs.selectExpr("text", "xxhash64(text) AS h").where("text IS NOT NULL").collect():
        c, text = class_of[r["h"]], r["text"]
        terms = terms_of(text)
        for t in terms:
            spelled[t].add(c)
        for e in {text[a:z] for _, a, z in brute(text)}:
            holds[e].add(c)
            for t in terms:
                together[(e, t)].add(c)
    total = len(set(class_of.values()))
    out = {}
    for (e, t), both in together.items():
        n_e, n_et, n_t = len(holds[e]), len(both), len(spelled[t])
        if n_et < pii.SUPPORT and n_et != n_t or n_e == total:
            continue
        risk = min(1.0, math.log(n_et * total / (n_e * (n_t + pii.PRIOR))) / math.log(total / n_e))
        if risk >= pii.GENERALISE:
            out[(e, t)] = risk
    return out


def terms_of(text):
    return {t for t in regex.findall(r"[\p{L}\p{N}]+", text.lower()) if len(t) >= pii.TERM_CHARS}


def plain_sanitised(text, risks):
    """The text with its base spans and the terms that disclose one of its own entities replaced."""
    base = brute(text)
    risky = defaultdict(float)
    for e in {text[a:z] for _, a, z in base}:
        for t in terms_of(text):
            if (e, t) in risks:
                risky[t] = max(risky[t], risks[(e, t)])
    spans = list(base)
    if risky:
        for m in regex.finditer(r"(?i)(?<![\p{L}\p{N}])(?:" + "|".join(sorted(risky)) + r")(?![\p{L}\p{N}])", text):
            if not any(a < m.end() and m.start() < z for _, a, z in base):
                spans.append(("term", m.start(), m.end()))
    out, at = [], 0
    for kind, a, z in sorted(spans, key=lambda s: (s[1], -s[2])):
        if a >= at:
            mark = f"<{kind.upper()}>" if kind != "term" or risky[text[a:z].lower()] < pii.REMOVE else ""
            out += [text[at:a], mark]
        at = max(at, z)
    return "".join(out) + text[at:]


def test_risks_are_those_of_plain_counts(spark):
    """disclosing_terms() against counts of classes in plain Python, over all documents of a table."""
    docs = table(spark, "documents", "/root/testdata/sf0.01")
    want = plain_risks(docs)
    held = docs.where("text IS NOT NULL").select("doc_id", "text", F.array_distinct(F.transform(pii.base_spans(F.col("text")), lambda s: s["value"])).alias("values")).where(F.size("values") > 0)
    got = {(r["entity"], r["term"]): r["risk"] for r in pii.disclosing_terms(docs, held).collect()}
    assert len(want) > 100 and got.keys() == want.keys()
    assert all(abs(got[k] - want[k]) < 1e-9 for k in want)


def test_terms_in_other_lines_and_far_away_go(spark):
    many = " ".join(["of the matter"] * 10)
    rows = [(0, "Quillon Underhill\nquil@x.org"), (1, f"Vandermeer spoke {many} to van@x.org"), (2, "Ostrander\n\nthe matter spoke\n\nost@x.org")]
    rows += [(10 + i, f"{i} spoke {i} of {i} the {i} matter {i} to no one") for i in range(60)]
    clean = {r["doc_id"]: r["text"] for r in pii.sanitise(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert clean[0] == "<TERM> <TERM>\n<EMAIL>" and clean[1] == f"<TERM> spoke {many} to <EMAIL>" and clean[2] == "<TERM>\n\nthe matter spoke\n\n<EMAIL>"
    assert all(clean[k] == text for k, text in rows if k >= 10)


def test_sanitise_keeps_rows_and_columns(spark):
    docs = table(spark, "documents")
    clean = pii.sanitise(docs)
    assert clean.columns == docs.columns and clean.count() == docs.count()
    assert sum(len(brute(r["text"])) for r in clean.collect()) == 0
    untouched = {r["doc_id"]: r["text"] for r in docs.collect() if not brute(r["text"])}
    assert all(r["text"] == untouched[r["doc_id"]] for r in clean.collect() if r["doc_id"] in untouched)
    odd = awkward(spark)
    assert pii.sanitise(odd).columns == odd.columns and pii.sanitise(odd).count() == odd.count()


URLS = ["http://Example.COM/en/x?q=/fr/", "https://www.example.com/en/", "http://a.www.example.com/en", "ftp://x.net/es/y#z", "http://net/fr/", "http://badexample.com/en/x", "noscheme.com/en/", None, "", "://", "http://", "http://example.com", "a://b.com/c://d.net/es/", "http://x.net/fr?/", "http://x.net\n/fr/1", "http://com./x", "http://example.com//en/"]


def brute_url(url, rules):
    m = re.match(r"(?s)(.*?)://([^/?#]*)([^?#]*)", url or "")
    host, path = (re.sub("[A-Z]", lambda c: c.group().lower(), m[2]), m[3]) if m else ("", "")
    fits = []
    for rule, action in rules:
        h, _, p = rule.partition("/")
        if (host == h or host.endswith("." + h)) and path.startswith("/" + p):
            fits.append((len(rule), rule, action))
    best = max(fits, default=(0, None, "allow"))
    return host, path, best[1], best[2]


def test_url_filter(spark):
    pages = spark.createDataFrame(list(enumerate(URLS)) + [(3, URLS[3])], "page_id long, url string").selectExpr("*", "1 AS rule", "2 AS b", "3 AS w", "4 AS _host")
    rules = queries.RULES + [("x.net/fr", "block"), ("com./", "block"), ("badexample.com", "block")]
    got = urlfilter.url_filter(pages, urlfilter.rules_frame(spark, rules))
    same(got.select("page_id", "host", "path", "rule", "verdict").collect(), [(r["page_id"], *brute_url(r["url"], rules)) for r in pages.collect()])
    real = table(spark, "pages").select("page_id", "url")
    many = queries.RULES + [(f"h{i}.org/p{i}/", "block") for i in range(3000)]
    listed = spark.createDataFrame(many, "rule string, action string")
    got = urlfilter.url_filter(real, listed)
    same(got.select("page_id", "host", "path", "rule", "verdict").collect(), [(r["page_id"], *brute_url(r["url"], many)) for r in real.collect()])
    assert urlfilter.url_filter(real.where("false"), listed).count() == 0
    none = urlfilter.url_filter(real, spark.createDataFrame([], "rule string, action string"))
    assert none.where("rule IS NULL AND verdict = 'allow'").count() == real.count()
