import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from ledgerlark.functions import quantities as Q
from ledgerlark.operators import contradictions as C
from ledgerlark.operators import extraction as X
from ledgerlark.operators import lexicon as L
from ledgerlark.operators import similarity as S
from ledgerlark.operators import temporal
from ledgerlark import schemas
from ledgerlark.sources import landed, sinks

INDEX = {"figures_noyau": ["jordan bardella", "marine le pen"], "parties": ["rassemblement national"], "sigles": ["rn"]}


def test_numbers():
    assert Q.number("35.000") == 35.0 and Q.number("1.234.567") == 1234567 and Q.number("1.234,5") == 12345 and Q.number("35 000") == 35000
    assert [(q["value"], q["unit_kind"]) for q in Q.typed("40 milliards d'euros, 47 % et 35 000 migrants")] == [(40, "milliards_eur"), (35000, "millions_eur"), (47, "pct")]
    assert [q["unit_kind"] for q in Q.typed("50 €")] == [] and [q["unit_kind"] for q in Q.typed("50 euros")] == ["eur"]


@pytest.mark.parametrize("text, n", [("condamnée à verser 6000 euros", None), ("400 sous-amendements", None), ("178 policiers et gendarmes blessés", None), ("35000 expulsions par an", 35000), ("en 2024", None)])
def test_plain_numbers(text, n):
    found = [q["value"] for q in Q.plain(text, Q.typed(text))]
    assert found == ([n] if n else [])


def test_claims(spark):
    triggers = {"cout": {"unit_kinds": ["milliards_eur"], "unit": "milliards_eur", "triggers": ["coût de l'immigration"]}, "nb": {"unit_kinds": ["nb"], "unit": "nb", "triggers": ["reconduite", "expuls"]}}
    df = spark.createDataFrame([(1, "Le coût de l'immigration est de 40 milliards d'euros. Il y a eu 35000 expulsions."), (2, None), (3, "")], "id int, text string")
    rows = X.extract_claims(df, triggers).collect()
    # the stem 'expuls' is matched as a whole word only, so the second sentence gives nothing
    assert [(r.id, r.referent_key, r.value) for r in rows] == [(1, "cout", 40.0)]


CASES = [
    ("Le RN présente son programme", True, "mention"),
    ("Jordan Bardella tient un meeting", True, "mention"),
    ("La météo sera belle sur la Bretagne", False, None),
    ("La France a tranché lors du scrutin", False, None),
    ("Le martin-pêcheur niche au bord", False, None),
    ("Selon Marine Le Pen, l'immigration coûte trop cher", True, "prise_de_parole"),
    ("Le RN dénonce la politique migratoire", True, "prise_de_parole"),
    ("Le RN ne finalement dénonce rien", True, "prise_de_parole"),
    ("Le RN est dénoncé par la majorité", True, "mention"),
    ("Bardella propose une loi", True, "prise_de_parole"),
    ("Marine Le Pen, dans un entretien, détaille sa position", True, "prise_de_parole"),
    ("Le RN progresse dans les sondages selon une étude récente", True, "mention"),
    ("Le RN " + "x" * 30 + " affirme", True, "mention"),
    ("Le RN " + "x" * 21 + " affirme", True, "prise_de_parole"),  # the verb ends with the thirtieth character
    ("Le RN " + "x" * 21 + " affirmerait", True, "prise_de_parole"),  # what lies beyond is cut off, so a word may begin like a verb
    ("", False, None),
    (None, False, None),
]


def test_relevance(spark):
    df = spark.createDataFrame([(i, t) for i, (t, _, _) in enumerate(CASES)], "id int, text string")
    got = {r.id: r for r in L.assess_relevance(df, ["Jordan Bardella", "Marine Le Pen", "Paul Martin"], INDEX).collect()}
    for i, (text, relevant, nature) in enumerate(CASES):
        assert (got[i].relevant, got[i].nature, got[i].is_statement) == (relevant, nature, nature == "prise_de_parole"), text
    assert got[0].keywords == ["RN"] and got[5].personalities == ["Marine Le Pen"] and got[1].personalities == ["Jordan Bardella"]
    both = spark.createDataFrame([("Bardella, Jordan Bardella au micro",)], "text string")
    r = L.assess_relevance(both, ["Jordan Bardella"], {"figures_noyau": [], "parties": [], "sigles": []}).first()
    assert r.personalities == ["Jordan Bardella", "Jordan Bardella"] and r.genre == "interview"


def test_themes(spark):
    lex = {"themes": {"b": {"salience": "haute", "keywords": ["prix", "place"], "subthemes": {"x": ["prix"]}}, "a": {"salience": "tres_haute", "keywords": ["frontière"]}}}
    rows = spark.createDataFrame([(1, "La frontière et le prix"), (2, "prix des places"), (3, "rien"), (4, None)], "id int, text string")
    got = {r.id: (r.theme, r.subtheme, r.secondary, r.score) for r in L.classify_themes(rows, lex).collect()}
    assert got == {1: ("a", None, "b", 1), 2: ("b", "x", None, 1), 3: (None, None, None, 0), 4: (None, None, None, 0)}


def claims(spark, rows):
    return spark.createDataFrame(rows, "id int, referent_key string, qty_unit_kind string, qty_value double, qty_unit string, speaker_name string, party string, published_at timestamp, verbatim string, stance_polarity string")


def test_stances(spark):
    day = dt.datetime(2026, 1, 1)
    c = claims(spark, [(1, "r", None, None, None, "A", "P", day, "v", "pour"), (2, "r", None, None, None, "B", "Q", day, "v", "contre"), (3, "r", None, None, None, "C", "P", day, "v", "pour")])
    e = C.stance_contradictions(c).collect()
    assert len(e) == 2 and {x.status for x in e} == {"pending"} and {x.score for x in e} == {0.7}


def test_types_and_nulls(spark):
    d1, d2 = dt.datetime(2026, 1, 1), dt.datetime(2026, 1, 2)
    who = {1: ("A", "P", d1), 2: ("A", "P", d2), 3: (None, "P", d1), 4: (None, "Q", None), 5: (None, None, None)}
    c = claims(spark, [(i, "r", "eur", float(10 ** i), "eur", s, p, t, None, None) for i, (s, p, t) in who.items()])
    got = {(r.claim_a_id, r.claim_b_id): r.type for r in C.numeric_contradictions(c).collect()}
    assert got[(1, 2)] == 1 and got[(1, 3)] == 2 and got[(1, 4)] == 3 and got[(3, 4)] == 3 and got[(4, 5)] == 6
    text = {r.rationale for r in C.numeric_contradictions(c).where("claim_a_id = 1 and claim_b_id = 2").collect()}
    assert text == {"revirement intra-locuteur — 10 eur (A, 2026-01-01)  ≠  100 eur (A, 2026-01-02)"}
    assert C.numeric_contradictions(claims(spark, [(1, "r", "eur", 100.0, "", None, None, None, None, None), (2, "r", "eur", 101.0, "", None, None, None, None, None)])).count() == 0
    edges = C.numeric_contradictions(c)
    assert C.new_edges(edges, edges.select(F.col("claim_b_id").alias("claim_a_id"), F.col("claim_a_id").alias("claim_b_id"))).count() == 0


def test_general_number(spark):
    xs = [35000.0, 0.0, 1.5, 1234567.0, -2.25, 0.00001234, 100.0, 3.14159265]
    got = [r[0] for r in spark.createDataFrame([(x,) for x in xs], "x double").select(C.general_number(F.col("x"))).collect()]
    assert got == [f"{x:g}" for x in xs]


def test_affiliation(spark):
    d = dt.date
    a = spark.createDataFrame([(1, 7, "LR", d(2022, 12, 11), d(2024, 6, 12)), (2, 7, "UDR", d(2024, 6, 12), None)], "id int, p int, party string, date_start date, date_end date")
    items = spark.createDataFrame([(1, 7, d(2023, 1, 1)), (2, 7, d(2025, 1, 1)), (3, 7, None), (4, 7, d(2000, 1, 1)), (5, 8, d(2023, 1, 1)), (6, 7, d(2024, 6, 12))], "item int, p int, at date")
    got = {r.item: r.party_at_date for r in temporal.affiliation_at(items, a, "item", "p", "at").collect()}
    assert got == {1: "LR", 2: "UDR", 3: "UDR", 4: "UDR", 5: None, 6: "LR"}


def test_groups(spark):
    assert S.greedy_groups([1, 2, 3], np.array([[1, 0, 0], [0.99, 0.02, 0], [0, 1, 0]]), 0.92) == [[1, 2], [3]]
    df = spark.createDataFrame([(1, None, [1.0, 0.0]), (2, None, [1.0, 0.1]), (3, "r", [1.0, 0.0])], "id int, referent_key string, embedding array<double>")
    assert [tuple(r.members) for r in S.near_duplicate_groups(df).collect()] == [(1, 2)]


@pytest.mark.parametrize("threshold", [0.3, 0.8])
def test_groups_by_first_fit(spark, monkeypatch, threshold):
    rng = np.random.default_rng(5)
    v = np.concatenate([rng.normal(size=(60, 3)), np.repeat(rng.normal(size=(1, 3)), 30, 0), np.zeros((2, 3))])
    rows = [(i, "ab"[i % 3 > 0] if i % 7 else None, x.tolist()) for i, x in enumerate(v)] + [(1000, "a", None)]
    df = spark.createDataFrame(rows, "id int, referent_key string, embedding array<double>").repartition(3)
    want = []
    for block in ("a", "b", None):
        groups = []
        for i, b, x in rows[:-1]:
            if b != block:
                continue
            near = lambda p: float(np.dot(x, p) / ((np.linalg.norm(x) * np.linalg.norm(p)) or 1)) >= threshold  # noqa: B023, E731
            first = next((g for g in groups if near(v[g[0]])), None)
            groups.append([i]) if first is None else first.append(i)
        want += [(block or "", g[0], g) for g in groups if len(g) > 1]
    got = S.near_duplicate_groups(df, threshold).collect()
    assert sorted((r.referent_key or "", r.pivot, list(r.members)) for r in got) == sorted(want) and all(r.size == len(r.members) for r in got)
    monkeypatch.setattr(S, "TILE_ROWS", 16)  # blocks of several tiles
    got = S.near_duplicate_groups(df, threshold).collect()
    assert sorted((r.referent_key or "", r.pivot, list(r.members)) for r in got) == sorted(want)


def test_cosine_of_nothing(spark):
    df = spark.createDataFrame([([0.0, 0.0], [1.0, 0.0]), ([], [1.0]), ([1.0, 2.0], [2.0, 4.0])], "a array<double>, b array<double>")
    assert [round(r[0], 6) for r in df.select(S.cosine("a", "b")).collect()] == [0.0, 0.0, 1.0]


def test_streaks(spark):
    rows = [("a", 1, "ok"), ("a", 2, "blocked"), ("a", 3, "blocked"), ("b", 1, "blocked"), ("b", 2, "ok")]
    got = {r.e: r.consecutive_failures for r in temporal.failure_streaks(spark.createDataFrame(rows, "e string, attempt_id int, status string"), "e").collect()}
    assert got == {"a": 2, "b": 0}


def test_feeds(spark):
    xml = '<?xml version="1.0"?><rss><channel><item><title>R to @E_R: bonjour</title><link>http://m/u/status/1#m</link></item><item><title>salut</title><link>http://m/u/status/2</link></item></channel></rss>'
    rows = landed.rss_posts(spark.createDataFrame([("u", xml), ("v", "not xml"), ("w", None)], "handle string, xml string")).orderBy("pos").collect()
    assert [(r.post_type, r.reply_to_handle) for r in rows] == [("reply", "E_R"), ("original", None)]


def test_timeline(spark):
    page = '<div class="timeline-item"><div class="quote"><a class="quote-link" href="/q/status/5"></a><div class="quote-text">cité</div></div><div class="tweet-content">texte</div></div><div class="timeline-item show-more"><a href="?cursor=x">more</a></div><div class="show-more"><a href="?cursor=y">m</a></div>'
    landed_ = spark.createDataFrame([("u", page)], "handle string, html string")
    r = landed.timeline_posts(landed_, base="https://m").first()
    assert (r.post_type, r.quoted_handle, r.quoted_content, r.quoted_url) == ("quote", "q", "cité", "https://m/q/status/5")
    assert landed.next_cursors(landed_).first().next_cursor == "?cursor=x"


def test_timeline_counts_beyond_int(spark):
    page = '<div class="timeline-item"><div class="tweet-content">t</div><div class="tweet-stat"><span class="icon-heart"></span> 5,671,680,234</div><div class="tweet-stat"><span class="icon-retweet"></span> 3000M</div></div>'
    posts = landed.timeline_posts(spark.createDataFrame([("u", page)], "handle string, html string"))
    assert tuple(posts.select("likes", "retweets", "quotes").first()) == (5671680234, 3_000_000_000, None)
    kept = sinks.conform(posts, schemas.schema("posts"))
    assert tuple(kept.select("likes", "retweets").first()) == (5671680234, 3_000_000_000)


def test_sinks(spark, tmp_path):
    rows = spark.createDataFrame([("a", 1), ("a", 2), ("b", 3)], "k string, v int")
    path = str(tmp_path / "t")
    assert sinks.insert_absent(rows, path, "k").first()[0] == 2
    assert sinks.insert_absent(rows, path, "k").first()[0] == 0
    people = lambda *r: spark.createDataFrame(list(r), "handle string, full_name string, role string")
    got = sinks.merge_people(people(("h", "A", "x"), (None, "B", None)), people(("h", "A2", None), (None, "B", "y"))).collect()
    assert {(r.handle, r.full_name, r.role) for r in got} == {("h", "A2", "x"), (None, "B", "y")}


def test_streaming(spark, tmp_path):
    from ledgerlark.streaming.ingest import failure_counts, ingest, landed_stream

    src, out = str(tmp_path / "in"), str(tmp_path / "out")
    spark.createDataFrame([("a", 1), ("b", 2)], "k string, v int").write.parquet(src)
    for _ in range(2):
        ingest(landed_stream(spark, src, "k string, v int"), lambda d: d, out, "k", str(tmp_path / "cp")).awaitTermination()
        spark.createDataFrame([("b", 3), ("c", 4)], "k string, v int").write.mode("append").parquet(src)
    assert sorted(r.k for r in spark.read.parquet(out).collect()) == ["a", "b", "c"]
    log = str(tmp_path / "log")
    spark.createDataFrame([("a", 1, "ok"), ("a", 2, "blocked"), ("b", 1, "blocked")], "entity string, attempt_id int, status string").write.parquet(log)
    q = failure_counts(landed_stream(spark, log, "entity string, attempt_id int, status string")).writeStream.format("memory").queryName("fails").outputMode("update").trigger(availableNow=True).start()
    q.awaitTermination()
    assert {r.entity: r.consecutive_failures for r in spark.table("fails").collect()} == {"a": 1, "b": 1}


def test_facts(spark):
    from ledgerlark.operators import reports

    rows = [(i, 1, None, f"propos {i}", "immigration", "normatif", dt.datetime(2026, 5, 12) + dt.timedelta(days=i)) for i in range(120)]
    c = spark.createDataFrame(rows, "id int, personality_id int, canonical string, verbatim string, theme string, claim_type string, published_at timestamp")
    lines = reports.facts(c, cap=40).first().facts.split("\n")
    assert len(lines) == 40 and lines[0] == "- [2026-09-08] (immigration/normatif) propos 119"


def test_schemas(spark):
    from ledgerlark import schemas

    assert len(schemas.names()) == 14
    got = sinks.conform(spark.createDataFrame([(1,)], "id long"), schemas.schema("themes"))
    assert got.columns[0] == "id" and len(got.columns) == 6
    assert [tuple(r) for r in sinks.schema_diff(spark, {"a": ["x"], "b": []}, {"a": []}).collect()] == [("b", None), ("a", "x")]


def test_landed_files(spark, tmp_path):
    assert landed.normalize_db_url("postgres://h/d") == "jdbc:postgresql://h/d" and landed.normalize_db_url("sqlite:///x.db") == "jdbc:sqlite:x.db" and landed.normalize_db_url("jdbc:h2:mem") == "jdbc:h2:mem"
    (tmp_path / "pool.json").write_text('{"figures": [{"name": "A", "handle": null}, {"name": "B", "handle": "b"}]}', encoding="utf-8")
    rows = landed.json_rows(spark, str(tmp_path / "pool.json")).select(F.explode("figures").alias("f")).select("f.*")
    assert sorted((r.name, r.handle) for r in rows.collect()) == [("A", None), ("B", "b")]
    (tmp_path / "m.csv").write_text('name,url\n"Le, Journal",http://j\nvide,\n', encoding="utf-8")
    assert sorted((r.name, r.url) for r in landed.csv_rows(spark, str(tmp_path / "m.csv")).collect()) == [("Le, Journal", "http://j"), ("vide", None)]


def test_embed(spark):
    df = spark.createDataFrame([(1, "abc"), (2, None), (3, "x" * 2000)], "id int, text string")
    got = {r.id: r.embedding for r in S.embed(df, lambda texts: [[float(len(t)), float(len(texts))] for t in texts], batch=2).collect()}
    assert {i: v[0] for i, v in got.items()} == {1: 3.0, 2: 0.0, 3: 1500.0} and all(v[1] <= 2 for v in got.values())


def test_edge_counts(spark):
    """As many edges of each type as pairs that detect finds, also at the bound, with missing names, two parties and equal dates."""
    rng = np.random.default_rng(5)
    pick = lambda *xs: xs[rng.integers(len(xs))]
    values = (0.0, 0.01, 0.02, 0.5, 0.99, 1.0, 1.01, 1.02, 49.0, 50.0, 51.0, -49.0, -50.0, -0.01, -0.02, -0.0, 98.0, 100.0, 1e308, -1e308, float("inf"), float("nan"))
    day = lambda: pick(None, *(dt.datetime(2024, 1, d) for d in (1, 2, 3)))
    rows = [(i, pick("r", "q", None), pick("eur", "pct", None), pick(None, *values, *values), pick(None, "", "s", "t"), pick(None, "", "p", "o"), day(), pick(None, "pour", "contre"), "v", "eur") for i in range(500)]
    c = spark.createDataFrame(rows, "id long, referent_key string, qty_unit_kind string, qty_value double, speaker_name string, party string, published_at timestamp, stance_polarity string, verbatim string, qty_unit string")
    want = {(r.referent_key, r.type): r.n for r in C.detect(c).groupBy("referent_key", "type").agg(F.count(F.lit(1)).alias("n")).collect()}
    got = {(r.referent_key, r.type): r.n for r in C.edge_counts(c).collect()}
    assert got == want and len(want) == 8
    assert C.edge_counts(c.where("false")).count() == 0
    many = spark.range(300_000).select("id", F.lit("r").alias("referent_key"), F.lit("eur").alias("qty_unit_kind"), F.when(F.col("id") % 2 == 0, 1.0).otherwise(2.0).alias("qty_value"), F.lit("s").alias("speaker_name"), F.lit("p").alias("party"), F.lit(None).cast("timestamp").alias("published_at"), F.lit(None).cast("string").alias("stance_polarity"))
    assert [tuple(r) for r in C.edge_counts(many).collect()] == [("r", 6, 150_000**2)]


def test_anchor_parts(spark, monkeypatch):
    rng = np.random.default_rng(3)
    v = rng.normal(size=(60, 4))
    df = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "k int, embedding array<double>")
    items, anchors = df.where("k >= 30").withColumnRenamed("k", "item"), df.where("k < 30").withColumnRenamed("k", "anchor")
    run = lambda: sorted(map(tuple, S.nearest_anchor(items, anchors, "item", "anchor", 0.1).collect()))
    pairs = lambda: [tuple(r) for r in S.fusion_candidates(df, 0.5, "k").collect()]
    whole, fused = run(), pairs()
    monkeypatch.setattr(S, "ANCHOR_ROWS", 7)
    assert run() == whole and len(whole) > 10 and pairs() == fused and len(fused) > 10
    monkeypatch.setattr(S, "MOST_PARTS", 2)
    with pytest.raises(ValueError):
        run()


def test_sniffers_and_time(spark):
    from ledgerlark.functions import text as T

    page = '<div class="timeline-item">' + "x" * 2000
    df = spark.createDataFrame([("  <?xml version='1.0'?><rss>",), ("<html>",), (page,), ("timeline-item",)], "x string")
    assert [tuple(r) for r in df.select(T.looks_like_rss("x"), T.looks_like_timeline("x")).collect()] == [(True, False), (False, False), (False, True), (False, False)]


def test_files_written(spark, tmp_path):
    import hashlib
    import json

    pages = spark.createDataFrame([("http://a", "<p>é</p>"), ("http://b", ""), (None, "x"), ("http://c", None)], "url string, html string").repartition(3)
    folder = str(tmp_path / "snap")
    first = {r.url: r.created for r in sinks.snapshots(pages, folder).collect()}
    again = {r.url: (r.created, r.path) for r in sinks.snapshots(pages.withColumn("html", F.lit("changed")).where("url <> 'http://c'"), "file://" + folder).collect()}
    assert first == {"http://a": True, "http://b": True} and {u: c for u, (c, _) in again.items()} == {"http://a": False, "http://b": False}
    assert (tmp_path / "snap" / (hashlib.sha256(b"http://a").hexdigest() + ".html")).read_text(encoding="utf-8") == "<p>é</p>" and len(list((tmp_path / "snap").iterdir())) == 2
    people = spark.createDataFrame([(2, "B", None), (1, "A", "a")], "id int, name string, handle string")
    sinks.json_document(people, str(tmp_path / "pool"), "id")
    assert json.loads("".join(p.read_text() for p in (tmp_path / "pool").glob("part-*"))) == [{"id": 1, "name": "A", "handle": "a"}, {"id": 2, "name": "B", "handle": None}]
    sinks.json_lines(people, str(tmp_path / "lines"))
    assert sorted(r.id for r in landed.json_rows(spark, str(tmp_path / "lines")).collect()) == [1, 2]


def test_article_lines(spark):
    text = "\n".join(["Un titre", "Un titre", "", "Un titre", "Lire aussi : x", "Un titre", "Suite", "", "", "", "Suite", "Fin"])
    got = spark.createDataFrame([(text,), (None,), ("Lire aussi x",), ("a\n" * 30_000,)], "t string").select(X.clean_article("t")).collect()
    assert [r[0] for r in got] == ["Un titre\n\nSuite\n\nFin", "", "", "a"]


def test_package_reaches_workers(spark):
    from ledgerlark.session import ship

    ship(spark), ship(spark)

    def where(batches):
        import sys

        for b in batches:
            yield b.assign(x=any("ledgerlark.zip" in p for p in sys.path))

    assert spark.range(1).selectExpr("false as x").mapInPandas(where, "x boolean").first()[0]
