"""Operators on documents against plain versions, planted cases and invariants."""

import json
import os
import random
import re
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tableworks.functions import blocks, pii
from tableworks.functions.repeats import covered_share
from tableworks.operators import bm25, overlap, schemas
from tableworks.operators import curation as C

TEXTS = "doc_id long, text string"


def prose(rng, n, words=400):
    return " ".join(f"w{min(int(rng.paretovariate(0.7)), words)}" for _ in range(n))


# --- personal data -------------------------------------------------------------------------------

FOUND = {
    "SECRET": ['token = "04dbebab91ab85687d33eeaaf9ac699e1188f962"', "API_KEY: abcdefgh12"], "EMAIL": ["tionou.73@mail9.example.com", "a+b@x-y.co.uk"],
    "IBAN": ["DE89370400440532013000", "GB82WEST12345698765432"], "CARD": ["4111111111111111", "4111 1111 1111 1111", "5500-0000-0000-0004"],
    "SSN": ["123-45-6789"], "PHONE": ["+1 (139) 555-2766", "(139) 555-2766", "139-555-2766"], "IP": ["60.197.159.133", "255.255.255.255"],
    "ACCOUNT": ["4111111111111112", "123456789012"],
}
CLEAN = ["FE5949719B6B82BC439E9329B", "000-45-6789", "666-45-6789", "923-45-6789", "123-00-6789", "256.1.1.1", "12345678901", "4111 1111 1111 1112", "a@b", "x = 5"]


def test_kinds_and_near_misses(spark):
    rows, want = [], {}
    for kind, values in FOUND.items():
        for v in values:
            rows.append((len(rows), f"Ünï {v}, end"))
            want[len(rows) - 1] = [(kind, 4, len(v))]
    start = len(rows)
    rows += [(start + i, f"so {v} it is") for i, v in enumerate(CLEAN)] + [(900, None), (901, "")]
    df = spark.createDataFrame(rows, TEXTS)
    got = defaultdict(list)
    for r in C.pii_detect(df, key="doc_id", text="text").collect():
        got[r.doc_id].append((r.kind, r.start, r["size"]))
    assert got == want
    redacted = {r.doc_id: r.text for r in C.pii_redact(df, col="text").collect()}
    assert all(redacted[i] == f"Ünï [{want[i][0][0]}], end" for i in want)
    assert all(redacted[start + i] == f"so {v} it is" for i, v in enumerate(CLEAN)) and redacted[900] is None and redacted[901] == ""


def test_spans_are_disjoint_and_redaction_leaves_the_rest(spark):
    rng, rows = random.Random(1), []
    pool = [v for values in FOUND.values() for v in values] + CLEAN + ["word", "é", "﷐x", "1", "-", "+1"]
    for i in range(300):
        rows.append((i % 250, rng.choice(["", " ", "\n"]).join(rng.choice(pool) for _ in range(rng.randint(0, 12)))))
    df = spark.createDataFrame(rows, TEXTS)
    spans = C.pii_detect(df.withColumn("row", F.monotonically_increasing_id()), key="row", text="text").collect()
    marked = {r.row: (r.text, r.red) for r in df.withColumn("row", F.monotonically_increasing_id()).withColumn("red", pii.redacted(pii.masked(F.col("text")))).collect()}
    by = defaultdict(list)
    for s in spans:
        by[s.row].append((s.start, s.start + s["size"], s.kind))
    assert len(by) > 200
    for row, (text, red) in marked.items():
        out, at = "", 0
        for a, b, kind in sorted(by[row]):
            assert a >= at and b > a
            out, at = out + text[at:a] + f"[{kind}]", b
        assert (out + text[at:]).replace("﷐", "�") == red


def test_planted_personal_data_is_found(spark, sf):
    docs = spark.read.parquet(os.path.join(sf, "documents.parquet")).select("doc_id", "text")
    kinds = Counter(r.kind for r in C.pii_detect(docs, key="doc_id", text="text").collect())
    texts = [r.text for r in docs.collect()]
    plain = {"EMAIL": r"[\w.]+@[\w.]+\.example\.com", "IP": r"\b\d+\.\d+\.\d+\.\d+\b", "PHONE": r"\+1 \(\d{3}\) 555-\d{4}", "SECRET": r'token = "[0-9a-f]{40}"'}
    for kind, pattern in plain.items():
        assert kinds[kind] == sum(len(re.findall(pattern, t)) for t in texts)
    assert kinds["CARD"] + kinds["ACCOUNT"] == sum(len(re.findall(r"\b\d{16}\b", t)) for t in texts)


# --- pages ---------------------------------------------------------------------------------------


def content(html):
    title, lang, found = blocks.page_blocks(html)
    return title, lang, [t for t, boiler in found if not boiler]


@pytest.mark.parametrize("html, want", [
    ("<html lang='EN-gb'><title> A &amp;\n B </title><body><p>one<p>two <b>bold</b> <a href=x>link</a> text", ("A & B", "en", ["one", "two bold link text"])),
    ("<nav><ul><li>menu<li>more</ul><article><h1>T</h1>left open nav<p>x</article>", (None, None, ["T", "left open nav", "x"])),
    ("<div><a href=1>all</a> <a href=2>links</a></div><div>half <a>half</a></div>", (None, None, ["half half"])),
    ("<script>if (a < b) { '<p>no</p>' }</script><style>p{}</style><p>yes<!-- no --><textarea>no</textarea></p></div></div>", (None, None, ["yes"])),
    ("<div class='main ad'>no</div><div id=sidebar>no<div>no</div></div><div class=lead>yes</div>", (None, None, ["yes"])),
    ("<table><tr><td>a<td>b<tr><td>c</table>tail<br>line&nbsp;&copy; &#65;", (None, None, ["a", "b", "c", "tail", "line © A"])),
    ("", (None, None, [])), ("no tags < here & there", (None, None, ["no tags < here & there"])), ("</p></x><p><p></p>", (None, None, [])),
    ("<header>h</header><main>m</main><footer>f</footer><title>second</title>", ("second", None, ["m"])),
])
def test_blocks_of_hand_made_pages(html, want):
    assert content(html) == want


def test_a_large_broken_page_and_nulls(spark):
    page = "<html><body><nav>" + "<div><p>word <b>x" * 200_000 + "<article>" + "<p>real text here" * 100_000
    assert len(page) > 5_000_000
    df = spark.createDataFrame([(1, page), (2, None), (3, "")], "id long, html string")
    rows = {r.id: r.p for r in df.select("id", blocks.page_text(F.col("html")).alias("p")).collect()}
    assert rows[1].text == "\n".join(["real text here"] * 100_000) and rows[2].text is None and rows[3].text == "" and rows[3].n_blocks == 0


# --- overlap, BM25 ---------------------------------------------------------------------------------


def plain_overlap(docs, items, n):
    out = {}
    cut = lambda t: re.findall(r"[^\W_]+", (t or "").lower())
    for i, text in items:
        w = cut(text)
        where = defaultdict(list)
        for k in range(len(w) - n + 1):
            where[tuple(w[k : k + n])].append(k)
        for d, doc in docs:
            v, shared, best = cut(doc), set(), 0
            run = Counter()
            for k in range(len(v) - n + 1):
                g = tuple(v[k : k + n])
                for j in where.get(g, ()):
                    shared.add(g)
                    run[k, j] = run[k - 1, j - 1] + 1
                    best = max(best, run[k, j] + n - 1)
            if shared:
                out[d, i] = (len(shared), round(len(shared) / len(where), 9), best)
    return out


@pytest.mark.parametrize("options", [{}, {"broadcast_bytes": 0}, {"slots": 1 << 10}])
def test_overlap_like_a_plain_search(spark, monkeypatch, options):
    if "slots" in options:
        monkeypatch.setattr(overlap, "MOST_SLOTS", options.pop("slots"))
    rng = random.Random(2)
    items = [(i, prose(rng, 30, 30)) for i in range(12)] + [(50, "too short"), (51, None), (52, items_text := "a b c d e f g h a b c d e f g h a b c d")]
    docs = [(i, prose(rng, 60, 30)) for i in range(30)]
    docs += [(100 + i, prose(rng, 20) + " " + items[i % 5][1].upper().replace(" ", ", ") + " " + prose(rng, 9)) for i in range(40)]  # a hot passage
    docs += [(200, items_text * 3), (201, None), (202, ""), (203, " ".join(items[7][1].split()[4:13]))]
    df, bench = spark.createDataFrame(docs, TEXTS), spark.createDataFrame(items, "doc_id long, q string")
    got = overlap.benchmark_overlap(df, bench.withColumnRenamed("doc_id", "item_id"), key="doc_id", text="text", item_key="item_id", item_text="q", n=5, **options)
    rows = {(r.doc_id, r.item_id): (r.n_shared, round(r.containment, 9), r.longest_run) for r in got.collect()}
    assert rows == plain_overlap(docs, items, 5)
    assert all(rows[100 + i, i % 5][1:] == (1.0, 30) for i in range(40))


def test_planted_benchmark_passages_are_found(spark, sf):
    docs, items = (spark.read.parquet(os.path.join(sf, f"{t}.parquet")) for t in ("documents", "benchmark"))
    got = overlap.benchmark_overlap(docs, items, key="doc_id", text="text", item_key="item_id", item_text="text")
    whole = {(r.doc_id, r.item_id) for r in got.where("containment = 1").collect()}
    texts, wanted = ([tuple(r) for r in x.collect()] for x in (docs.select("doc_id", "text"), items.select("item_id", "text")))
    inside = {(d, i) for d, t in texts for i, q in wanted if q in t and len(re.findall(r"[^\W_]+", q)) >= 8}
    assert inside and inside <= whole


@pytest.mark.parametrize("block, seeds", [(5, 1), (40, 2), (1000, 3)])
def test_bm25_by_blocks_is_bm25_over_all(spark, tmp_path, block, seeds):
    import math

    rng = random.Random(3)
    docs = [(i, prose(rng, rng.randint(1, 60))) for i in range(200)] + [(500 + i, "w1 copy") for i in range(30)] + [(900, None), (901, "...")]
    queries = [(i, prose(rng, 6)) for i in range(15)] + [(50, "absent"), (51, None), (52, "w1 w1 copy")]
    index = bm25.bm25_index(spark.createDataFrame(docs, TEXTS), str(tmp_path / "x"), key="doc_id", text="text", block_docs=block)
    got = bm25.bm25_topk(index, spark.createDataFrame(queries, "q long, t string"), key="q", text="t", k=7, seeds=seeds).collect()
    bags = {d: Counter(re.findall(r"\w+", t)) for d, t in docs if t and re.findall(r"\w+", t)}
    n, mean = len(bags), sum(b.total() for b in bags.values()) / len(bags)
    df = Counter(w for b in bags.values() for w in b)
    for q, text in queries:
        scores = Counter()
        for d, b in bags.items():
            for w in (text or "").split():
                if w in b:
                    scores[d] += math.log(1 + (n - df[w] + 0.5) / (df[w] + 0.5)) * b[w] * 2.2 / (b[w] + 1.2 * (0.25 + 0.75 * b.total() / mean))
        mine = sorted((r["rank"], r.score, r.doc) for r in got if r.q == q)
        assert [round(s, 9) for _, s, _ in mine] == [round(s, 9) for s in sorted(scores.values(), reverse=True)[:7]]
        assert all(round(scores[d], 9) == round(s, 9) for _, s, d in mine) and [r for r, *_ in mine] == list(range(1, len(mine) + 1))


@pytest.mark.parametrize("queries_at_once, small", [(1024, 1_000_000), (4, 0)])
def test_bm25_with_repeated_keys_and_many_queries(spark, tmp_path, monkeypatch, queries_at_once, small):
    import math

    for name, value in {"PART_QUERIES": queries_at_once, "BROADCAST_DOCS": small, "BROADCAST_TERMS": small, "BROADCAST_VOCABULARY": small}.items():
        monkeypatch.setattr(bm25, name, value, raising=False)
    rng = random.Random(5)
    docs = [(i % 70, prose(rng, rng.randint(1, 30))) for i in range(100)] + [(None, "w1 w2"), (3, None), (99, "...")]
    queries = [(i, prose(rng, 5)) for i in range(20)]
    index = bm25.bm25_index(spark.createDataFrame(docs, TEXTS), str(tmp_path / "x"), key="doc_id", text="text", block_docs=9)
    out = bm25.bm25_topk(index, spark.createDataFrame(queries, "q long, t string"), key="q", text="t", k=4)
    bags = {}
    for d, t in docs:
        bags.setdefault(d, Counter()).update(re.findall(r"\w+", t or ""))
    bags = {d: b for d, b in bags.items() if b}
    n, mean = len(bags), sum(b.total() for b in bags.values()) / len(bags)
    df, got = Counter(w for b in bags.values() for w in b), out.collect()
    for q, text in queries:
        scores = Counter()
        for d, b in bags.items():
            for w in text.split() if d is not None else ():
                if w in b:
                    scores[d] += math.log(1 + (n - df[w] + 0.5) / (df[w] + 0.5)) * b[w] * 2.2 / (b[w] + 1.2 * (0.25 + 0.75 * b.total() / mean))
        assert [round(r.score, 9) for r in sorted(got, key=lambda r: r["rank"]) if r.q == q] == [round(s, 9) for s in sorted(scores.values(), reverse=True)[:4]]
    assert not re.search(r"hashpartitioning\(query#\w+, doc#", out._jdf.queryExecution().executedPlan().toString())  # pairs are not shuffled


def test_bm25_index_holds_a_row_for_each_block_and_term_and_no_other_copy(spark, tmp_path):
    rng = random.Random(8)
    docs = [(i % 90, prose(rng, rng.randint(1, 40))) for i in range(100)] + [(None, "w1"), (None, "w1 w2"), (95, None), (96, "...")]
    index = bm25.bm25_index(spark.createDataFrame(docs, TEXTS), str(tmp_path / "x"), key="doc_id", text="text", block_docs=20)
    assert sorted(p.name for p in (tmp_path / "x").iterdir()) == ["frequency", "postings"]
    bags, rows = {}, index.postings.collect()
    for d, t in docs:
        bags.setdefault(d, Counter()).update(re.findall(r"\w+", t or ""))
    assert len({(r.block, r.term) for r in rows}) == len(rows) and len({r.block for r in rows}) > 2
    found = {(d, r.term): (tf, size) for r in rows for d, tf, size in zip(r.docs, r.tfs, r.sizes, strict=True)}
    assert found == {(d, w): (tf, b.total()) for d, b in bags.items() for w, tf in b.items()}


# --- schemas ---------------------------------------------------------------------------------------


def test_schema_paths_and_any_order_of_merging(spark):
    schema = T.StructType([
        T.StructField("a", T.LongType(), False), T.StructField("b", T.StructType([T.StructField("c", T.DoubleType())])),
        T.StructField("d", T.ArrayType(T.ArrayType(T.StringType(), False))),
    ])
    cases = [
        ('{"a": 1}', None), ('{"a": 1, "b": {"c": 2}, "d": [["x"], []], "z": 1}', None), ('{"a": 1.5}', "$.a"), ('{"a": null}', "$.a"), ("{}", "$.a"), ("[]", "$"), ("1", "$"),
        ("", "$"), (None, "$"), ('{"a": 1', "$"), ('{"a": 1} x', "$"), ('{"a": 1, "b": 3}', "$.b"), ('{"a": 1, "b": {"c": "x"}}', "$.b.c"), ('{"a": 1, "b": null, "d": null}', None),
        ('{"a": 1, "d": [["x", 5]]}', "$.d[][]"), ('{"a": 1, "d": [["x", null]]}', "$.d[][]"), ('{"a": 1, "d": ["x"]}', "$.d[]"), ('{"a": 1, "d": {}}', "$.d"),
    ]
    df = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(cases)], "id long, t string")
    got = {r.id: r.failed_path for r in schemas.schema_check(df, text="t", schema=schema).collect()}
    assert got == {i: p for i, (_, p) in enumerate(cases)}
    records = [json.dumps(x) for x in ({"a": 1}, {"a": 2.5, "b": [1]}, {"a": None, "b": ["x"]}, {"c": {"d": True}}, {"c": {"d": "x"}})]
    merged = set()
    for parts in (1, 5):
        for order in (records, records[::-1]):
            rows = spark.createDataFrame([(r,) for r in [*order, "broken", None]], "t string").repartition(parts)
            merged.add(tuple(schemas.infer_schema(rows, text="t").first()))
    assert len(merged) == 1
    n_rows, n_json, schema = merged.pop()
    assert (n_rows, n_json) == (7, 5) and schema.startswith("OBJECT<a: ") and "b: ARRAY<VARIANT>" in schema and "d: VARIANT" in schema


# --- the rest ---------------------------------------------------------------------------------------


@pytest.mark.parametrize("digits", [1, 2, 6])
def test_samples_are_nested_and_exact(spark, digits):
    import hashlib

    rows = [(i, "hot" if i % 3 else ["a", None][i % 2]) for i in range(500)] + [(1000, "tiny")]
    df = spark.createDataFrame(rows, "id long, s string")
    sizes = {"s1": 3, "s2": 20, "s3": 200}
    got = {r.id: (r.sample, r.probability) for r in C.scale_sample(df, key="id", sizes=sizes, by=["s"], digits=digits).collect()}
    want = {}
    for s in {r[1] for r in rows}:
        ids = sorted((i for i, t in rows if t == s), key=lambda i: hashlib.md5(str(i).encode()).hexdigest())
        for k, i in enumerate(ids[:200]):
            name = next(n for n, size in sizes.items() if k < size)
            want[i] = (name, min(1.0, sizes[name] / len(ids)))
    assert got == want
    whole = C.scale_sample(df, key="id", sizes=sizes, digits=digits).groupBy("sample").count().collect()
    assert {r["sample"]: r["count"] for r in whole} == {"s1": 3, "s2": 17, "s3": 180}
    with pytest.raises(Exception, match="null in key"):
        C.scale_sample(spark.createDataFrame([(None, "x")], "id long, s string"), key="id", sizes=sizes).collect()


def test_statistics_tell_nulls_from_totals(spark):
    rows = [("en", None, "a b"), ("en", None, "a b"), (None, "x", None), ("de", "x", "")] + [("en", "hot", f"t{i}") for i in range(3000)]
    got = {(r.lang, r.source, r.level): r for r in C.partition_stats(spark.createDataFrame(rows, "lang string, source string, text string"), by=["lang", "source"], text="text").collect()}
    assert len(got) == len({(a, b) for a, b, _ in rows}) + 3 + 1
    assert got["en", None, 0].n_rows == 2 and got["en", None, 1].n_rows == 3002 and got[None, None, 2].n_rows == 3004
    assert got[None, "x", 0].n_null == 1 and got[None, "x", 0].n_words == 0 and got["en", None, 0].n_words == 4
    assert abs(got[None, None, 2].distinct_sketch - 3002) < 150


def test_repeated_runs_cover_what_a_plain_count_finds():
    rng = random.Random(4)
    for _ in range(200):
        words = [rng.choice("abcd") * rng.randint(1, 3) for _ in range(rng.randint(0, 40))]
        n = rng.randint(1, 4)
        runs = Counter(tuple(words[k : k + n]) for k in range(len(words) - n + 1))
        covered = {j for k in range(len(words) - n + 1) if runs[tuple(words[k : k + n])] > 1 for j in range(k, k + n)}
        want = sum(len(words[j]) for j in covered) / sum(map(len, words)) if words else 0.0
        assert covered_share(", ".join(words), n) == pytest.approx(want)
    assert covered_share("", 5) == 0.0 == covered_share("¿?", 1)


def test_copies_and_flags(spark):
    rows = [(5, "A  b\n"), (3, "a B"), (9, " a b "), (7, None), (8, None), (None, "a b"), (4, "other"), (4, "other")]
    got = sorted((tuple(r) for r in C.exact_dedup(spark.createDataFrame(rows, TEXTS), key="doc_id", text="text").collect()), key=str)
    assert got == sorted([(5, 3, 4, False), (3, 3, 4, True), (9, 3, 4, False), (7, 7, 1, True), (8, 8, 1, True), (None, 3, 4, False), (4, 4, 2, True), (4, 4, 2, True)], key=str)
    labels = spark.createDataFrame([(3, 1), (3, 0), (5, 0), (9, None), (None, 1)], "doc_id long, toxic int")
    df = spark.createDataFrame([(i, "s") for i in (3, 5, 9, 4)] + [(None, None)], "doc_id long, source string")
    assert sorted(r.doc_id or 0 for r in C.safety_filter(df, labels, key="doc_id", flag="toxic").collect()) == [0, 4, 5, 9]
    rates = {r.source: tuple(r)[1:] for r in C.safety_rates(df, labels, key="doc_id", flag="toxic", by="source").collect()}
    assert rates == {"s": (4, 2, 1, 0.5), None: (1, 0, 0, None)}
