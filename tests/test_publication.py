import json
import time
from datetime import date
from decimal import Decimal as D

import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from tallyspark import cli
from tallyspark.config import ExperimentPlan, ProfileBatch, ScoreBatch
from tallyspark.operators import customers, ledger
from tallyspark.plans import experiment, publication, serving, stored
from tallyspark.plans.folder import Folder
from tallyspark.sources import workbook
from test_ledger import FACTS, ROWS, fact, raw, shuffles


def test_release_is_named_by_its_content(spark, tmp_path):
    source = raw(spark, ROWS)
    one = publication.build_release(source, tmp_path, "sha", 10, "v1")
    assert publication.build_release(source, tmp_path, "sha", 10, "v1") == one != publication.build_release(source, tmp_path, "sha", 10, "v2")
    assert publication.release_table(spark, tmp_path, one, "facts").count() == 3 and json.loads((tmp_path / one / "quality.json").read_text())["rows"] == 10
    tables = publication.register_release(spark, tmp_path, one, "t")
    assert tables[1] == "t_facts" and spark.table("t_facts").count() == 3 and "rows" in {r.col_name: r.data_type for r in spark.sql("DESCRIBE EXTENDED t_facts").collect()}["Statistics"]
    next((tmp_path / one / "products").glob("*.parquet")).write_bytes(b"x")
    with pytest.raises(publication.PublicationError):
        publication.build_release(source, tmp_path, "sha", 10, "v1")


def test_months_of_a_release_build_no_dictionaries_of_ids(spark, tmp_path):
    """Ids, numbers of rows and amounts are plain, even where few are there; what repeats keeps its dictionary."""
    rows = [(f"h{n % 40}", str(n), "A", "apple", "2", "2011-01-05T10:00", "2.5", "c1", "UK") for n in range(800)]
    one = publication.build_release(raw(spark, rows), tmp_path, "sha", 800, "v1")
    coded = lambda c: c.has_dictionary_page or any("DICTIONARY" in e for e in c.encodings)
    for table, count in (("audit", 800), ("facts", 40)):
        files = list((tmp_path / one / table).rglob("*.parquet"))
        assert files and spark.read.parquet(str(tmp_path / one / table)).count() == count
        for f in files:
            group = pq.ParquetFile(f).metadata.row_group(0)
            columns = {(c := group.column(k)).path_in_schema: c for k in range(group.num_columns)}
            assert not [c for c in ("source_row_id", "source_row", "content_hash", "signed_amount", "duplicate_of") if coded(columns[c])] and coded(columns["country"])
            assert {c.compression for c in columns.values()} == {"ZSTD"}


def _copies(spark, n=800):
    """Rows of one month; a content comes twenty times, an order has two contents."""
    rows = [(f"{n % 40 // 2}-{n % 2}", str(n), f"S{n % 7}", "apple", "2", "2011-01-05T10:00", "2.5", f"c{n % 9}", "UK") for n in range(n)]
    return raw(spark, rows).withColumn("k", F.substring_index("content_hash", "-", 1).cast("long"))


def test_dealt_rows_are_classified_where_they_are(spark, tmp_path):
    """A landing in buckets by what equal contents share needs no exchange, and its release holds what any other does."""
    rows = _copies(spark)
    plain = publication.build_release(rows.drop("k"), tmp_path / "a", "sha", 800, "v1")
    with workbook.dealt_landing(rows.repartition(6, "k"), f"file://{tmp_path}/landing", "k", 6) as landing:
        assert sorted(landing.drop("k").collect()) == sorted(rows.drop("k").collect())
        assert shuffles(ledger.classify(landing, ("k",)))[0] == 0 and shuffles(ledger.classify(landing))[0] == 1
        dealt = publication.build_release(landing, tmp_path / "b", "sha", 800, "v1", dealt_by=("k",))
        name = [t.name for t in spark.catalog.listTables() if t.name.startswith("landing_")]
        assert len(name) == 1
    assert not spark.catalog.tableExists(name[0]) and len(list((tmp_path / "landing").glob("*.csv.gz"))) == 6
    for table in ("audit", "facts", "customers", "products"):
        one, two = (publication.release_table(spark, tmp_path / x, r, table) for x, r in (("a", plain), ("b", dealt)))
        assert one.count() == two.count() > 0 and one.exceptAll(two.select(one.columns)).count() == 0
    assert (tmp_path / "a" / plain / "quality.json").read_text() == (tmp_path / "b" / dealt / "quality.json").read_text()


def test_order_lines_of_a_release_are_dealt_out_once(spark, monkeypatch):
    """From the tables to the audit lines are shuffled once, by order: the landing keeps them so."""
    seen, write = [], publication._write_months
    monkeypatch.setattr(publication, "_write_months", lambda rows, path: (seen.append(shuffles(rows)[0]), write(rows, path)))
    assert stored.release_facts(spark, "/root/testdata/sf0.001").count() > 0 and seen == [0, 0]


def test_rows_of_a_release_are_sorted_in_parts_of_bounded_size(spark, tmp_path, monkeypatch):
    """The tasks that classify follow the rows, whatever the session's shuffles and the landing's buckets are."""
    monkeypatch.setattr(publication, "ROWS", 100)
    rows = _copies(spark)
    one = publication.build_release(rows.drop("k"), tmp_path / "a", "sha", 800, "v1")
    with workbook.dealt_landing(rows.repartition(12, "k"), f"file://{tmp_path}/landing", "k", 12) as landing:
        two = publication.build_release(landing, tmp_path / "b", "sha", 800, "v1", dealt_by=("k",))
    for files in (list((tmp_path / x / r / "audit").rglob("*.parquet")) for x, r in (("a", one), ("b", two))):
        assert 4 < len(files) <= 8


def _shuffle_files(spark):
    files = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
    return {n.rsplit("/", 1)[1] for n in files.mkString("\n").split("\n") if "/shuffle_" in n}


def test_shuffle_files_of_a_release_go_with_its_steps(spark, tmp_path):
    for step in (lambda: publication.build_release(_copies(spark).drop("k"), tmp_path, "sha", 800, "v1"), lambda: stored.ledger_reconciliation(spark, "/root/testdata/sf0.001")):
        before = _shuffle_files(spark)
        step()
        for _ in range(50):  # they are removed without waiting for it
            if not _shuffle_files(spark) - before:
                break
            time.sleep(0.2)
        assert not _shuffle_files(spark) - before and spark.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled") == "false"


def test_keys_and_figures_of_a_release(spark, tmp_path):
    """Counts by key say what a join of each fact says; names that no fact has are counted in the profile too; other facts are refused."""
    lost = [("h20", "108", "Z", "x", "1", "never", "1", "c7", "UK")]
    audit = ledger.classify(raw(spark, ROWS + lost))
    facts, lines = ledger.facts(audit), F.count("*").alias("lines")
    products, people = ledger.products(facts), ledger.customers(facts)
    keys = ledger.products(facts, lines), ledger.customers(facts, lines)
    for p, c in ((products, people), (products.where("stock_code = 'A'"), people.limit(0))):
        assert ledger.key_matches(*keys, p, c).select("fact_rows", "product_matches", "customer_matches").first() == ledger.dimension_matches(facts, p, c).first()
    assert ledger.input_profile(audit, products, people).first() == ledger.input_profile(audit).first() and ledger.input_profile(audit).first()["products"] == 3
    none = facts.limit(0)
    assert tuple(ledger.key_matches(ledger.products(none, lines), ledger.customers(none, lines), products, people).first()) == (0, 0, 0, 0)
    source = raw(spark, ROWS + lost)
    assert ledger.reconcile(source, audit, facts, products, people, 11, keys=keys, parts=3) == ledger.reconcile(source, audit, facts, products, people, 11)
    with pytest.raises(ledger.ReconciliationError):
        ledger.reconcile(source, audit, facts, products.limit(1), people, 11, keys=keys)
    twice = people.unionByName(people)
    with pytest.raises(ledger.ReconciliationError):
        ledger.reconcile(source, audit, facts, products, twice, 11, keys=keys)
    # as many facts of the same amount, but one of them is another's copy
    forged = facts.withColumn("source_row_id", F.when(F.col("source_row_id") == "r1", "r2").otherwise(F.col("source_row_id")))
    with pytest.raises(ledger.ReconciliationError):
        ledger.reconcile(source, audit, forged, products, people, 11)


def test_a_failed_release_leaves_nothing(spark, tmp_path):
    with pytest.raises(Exception, match="manifest"):
        publication.build_release(raw(spark, ROWS), tmp_path, "sha", 11, "v1")
    assert [p.name for p in tmp_path.iterdir() if not p.name.endswith(".crc")] == []


def test_a_dead_writers_lock_is_taken_over(spark, tmp_path):
    """The first writer stops renewing; the second takes over; what the first still wants to publish is refused."""
    root = Folder.of(spark, tmp_path)
    first, second = publication.Lease(root / "l", 3.0), publication.Lease(root / "l", 60.0)
    first.acquire()
    first.check()
    with pytest.raises(publication.PublicationError):
        second.acquire()
    time.sleep(3.2)
    second.acquire()
    assert (first.number, second.number) == (1, 2)

    def fill(part):
        (part / "x").write("1")
        return {}

    with pytest.raises(publication.PublicationError):
        publication.publish_folder(root / "t", fill, first)
    assert not (root / "t").exists() and not [n for n in root.names() if n.startswith("incoming")]
    assert publication.publish_folder(root / "t", fill, second)["writer"] == 2
    with pytest.raises(publication.PublicationError):
        first.renew()
    first.release()  # leaves the other's lock
    second.check()
    second.release()
    assert not (root / "l").exists()
    store = publication.BatchStore(spark, root)
    write = publication.write_json
    (root / "d").make()
    write(root / "d" / "current.json", {"batch": "b", "writer": 9})
    second.acquire()
    with pytest.raises(publication.PublicationError):
        store._move_head("d", "c", second)
    assert store.current("d") == "b"


def test_a_lock_is_renewed(spark, tmp_path):
    lock = Folder.of(spark, tmp_path) / "l"
    with publication.writer_lock(lock, 3.0) as lease:
        time.sleep(4)
        lease.check()
        with pytest.raises(publication.PublicationError):
            publication.Lease(lock).acquire()
    assert not lock.exists()


def test_lock_and_archive(spark, tmp_path):
    lock = Folder.of(spark, tmp_path) / "l"
    with publication.writer_lock(lock), pytest.raises(publication.PublicationError), publication.writer_lock(lock):
        pass
    with publication.writer_lock(lock):
        assert lock.exists()
    assert not lock.exists()
    (tmp_path / "in.txt").write_text("x")
    folder = publication.archive_source(spark, tmp_path / "in.txt", tmp_path / "raw")
    assert publication.archive_source(spark, tmp_path / "in.txt", tmp_path / "raw").uri == folder.uri
    (tmp_path / "raw" / folder.uri.rsplit("/", 1)[1] / "in.txt").write_text("y")
    with pytest.raises(publication.PublicationError):
        publication.archive_source(spark, tmp_path / "in.txt", tmp_path / "raw")


def test_small_files_are_replaced_whole(spark, tmp_path):
    place = Folder.of(spark, f"file://{tmp_path}/a") / "head.json"
    place.parent.make()
    for n in range(3):
        publication.write_json(place, {"n": n})
    assert json.loads(place.read()) == {"n": 2} and not place.claim("x") and [p for p in (tmp_path / "a").iterdir() if p.suffix == ".tmp"] == []


def profile_rows(spark, *ids):
    rows = [(i, "UK", 3, 2, D("5"), D(0), "A", 3, 2, 1, "REPEAT_CUSTOMER") for i in ids]
    return spark.createDataFrame(rows, "customer_id string, country string, recency_days int, orders long, purchase_amount decimal(30,6), cancellation_amount decimal(30,6), preferred_product string, r_score int, f_score int, m_score int, segment string")


def test_profiles_and_scores(spark, tmp_path):
    service = serving.CustomerService(spark, tmp_path)
    batch = lambda i: ProfileBatch(i, "d", "r", "v", date(2011, 6, 1))
    assert service.page("d") is None
    assert service.publish_profiles(batch("p1"), profile_rows(spark, "a", "b", "c")) and service.publish_profiles(batch("p2"), profile_rows(spark, "a", "b"))
    assert not service.publish_profiles(batch("p1"), profile_rows(spark, "c", "b", "a"))  # the same rows again
    assert service.profiles.current("d") == "p2"  # and the head stays
    with pytest.raises(publication.PublicationError):
        service.publish_profiles(batch("p1"), profile_rows(spark, "a"))
    with pytest.raises(publication.PublicationError):
        service.publish_profiles(batch("p3"), profile_rows(spark, "a").withColumn("orders", F.lit(0).cast("long")))
    assert service.page("d", "p1", limit=2).count() == 2 and service.detail("d", "a")["country"] == "UK"
    with pytest.raises(serving.UnknownCustomer):
        service.detail("d", "c")
    scores = spark.createDataFrame([("a", 0.5), ("b", 0.1234567890125)], "customer_id string, score double")
    assert service.publish_scores("d", ScoreBatch("s1", "p2", "m", "logistic", 30), scores)
    assert service.prediction("d", "b")["score"] == D("0.123456789013") and service.prediction("d", "b", "p1") is None and service.prediction("other", "b") is None
    for bad in (scores.limit(1), scores.withColumn("score", F.lit(1.5))):
        with pytest.raises(publication.PublicationError):
            service.publish_scores("d", ScoreBatch("s2", "p2", "m", "logistic", 30), bad)
    assert service.segments("d").first().customers == 2 and service.health()


def _opened(rows):
    """Names of the files that a frame reads."""
    return {f.rsplit("/", 1)[1] for f in rows.inputFiles()}


@pytest.fixture
def many_files(spark):
    """Sorted writes leave a file to each range."""
    before = {k: spark.conf.get(k) for k in ("spark.sql.adaptive.coalescePartitions.enabled", "spark.sql.shuffle.partitions")}
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    spark.conf.set("spark.sql.shuffle.partitions", "12")
    yield
    for k, v in before.items():
        spark.conf.set(k, v)


def test_lookups_open_the_files_that_hold_the_key(spark, tmp_path, many_files):
    service = serving.CustomerService(spark, tmp_path)
    ids = [f"c{n:04d}" for n in range(0, 1200, 2)]
    rare = F.when(F.col("customer_id").isin("c0002", "c0600", "c1198"), "RARE").otherwise("REPEAT_CUSTOMER")
    rows = profile_rows(spark, *ids).withColumn("segment", rare)
    assert service.publish_profiles(ProfileBatch("p1", "d", "r", "v", date(2011, 6, 1)), rows)
    publication.verify(Folder.of(spark, tmp_path) / "profiles" / "d" / "p1")
    everything = _opened(service.profiles.rows("d"))
    assert len(everything) == 12
    for key in (ids[0], ids[-1], "c0600", "c0050"):
        found = service.profiles.lookup("d", key)
        assert len(_opened(found)) == 1 and [r.customer_id for r in found.collect()] == [key] and service.detail("d", key)["customer_id"] == key
    for key in ("", "c0051", "zzz"):  # before, between and after all
        assert len(_opened(service.profiles.lookup("d", key))) <= 1 and service.profiles.lookup("d", key).count() == 0
        with pytest.raises(serving.UnknownCustomer):
            service.detail("d", key)
    first = service.page("d", limit=10)
    assert len(_opened(first)) == 1 and [r.customer_id for r in first.collect()] == ids[:10]
    whole = service.profiles.rows("d").withColumn("batch", F.lit("p1"))
    for kw in ({"after": "c0007"}, {"after": ids[-2]}, {"after": ids[-1]}, {"after": "zzz"}, {"segment": "RARE"}, {"segment": "RARE", "after": "c0002", "limit": 1}, {"segment": "NONE"}, {"customer_id": "c0600"}, {"customer_id": "c0600", "segment": "NONE"}, {"customer_id": "c0600", "after": "c0601"}):
        kw = {"limit": 30} | kw
        assert service.page("d", **kw).collect() == customers.page(whole, **kw).collect(), kw
    assert len(_opened(service.page("d", segment="RARE"))) == 3 and len(_opened(service.page("d", segment="RARE", after="c0002", limit=1))) == 2
    pages, after = [], None
    while True:  # every page, from one id to the next, whatever files it lies in
        got = service.page("d", "p1", limit=100, after=after).collect()
        pages += [r.customer_id for r in got]
        if not got or not got[-1].has_more:
            break
        after = got[-1].customer_id
    assert pages == ids
    with pytest.raises(ValueError):
        service.page("d", limit=0)


def test_scores_are_looked_up_alike(spark, tmp_path, many_files):
    service = serving.CustomerService(spark, tmp_path)
    ids = [f"c{n:04d}" for n in range(600)]
    service.publish_profiles(ProfileBatch("p1", "d", "r", "v", date(2011, 6, 1)), profile_rows(spark, *ids))
    service.publish_scores("d", ScoreBatch("s1", "p1", "m", "logistic", 30), spark.createDataFrame([(i, 0.25) for i in ids], "customer_id string, score double"))
    assert len(_opened(service.scores.rows("d"))) == 12 and len(_opened(service.scores.lookup("d", ids[77]))) == 1
    assert service.prediction("d", ids[77])["score"] == D("0.25") and service.prediction("d", "nobody") is None


def test_a_batch_without_ranges_is_read_whole(spark, tmp_path):
    """Batches that were published before there were ranges, and keys that repeat across files."""
    store = publication.BatchStore(spark, tmp_path, facets=("f",))
    rows = spark.createDataFrame([(k, v) for k in ("a", "b", "b", "b", "c") for v in ("x", "y")], "customer_id string, f string")
    spark.conf.set("spark.sql.files.maxRecordsPerFile", "2")
    try:
        store.publish("d", "b1", "about", rows)
    finally:
        spark.conf.unset("spark.sql.files.maxRecordsPerFile")
    assert store.lookup("d", "b").count() == 6 and 3 <= len(_opened(store.lookup("d", "b"))) < len(_opened(store.rows("d")))
    assert store.following("d", 3, "a", f="x").where("f = 'x' AND customer_id > 'a'").count() >= 3
    (Folder.of(spark, tmp_path) / "d" / "b1" / "ranges").remove()
    assert store.lookup("d", "b").count() == 6 and store.following("d", 1, "b").count() == 10
    assert store.lookup("none", "b") is None and store.following("none", 1) is None


def test_experiment(spark, tmp_path):
    rows = []
    for i in range(90):
        for month in range(1, 12):
            if (i + month * (1 + i % 3)) % (2 + i % 4) == 0:
                rows.append(fact(f"c{i}", f"2011-{month:02d}-{1 + i % 27:02d} 10:00:00", str(5 + i % 17), f"i{i}-{month}", f"S{i % 5}", row=f"r{i}-{month}"))
    facts = spark.createDataFrame(rows, FACTS).coalesce(1).persist()
    plan = ExperimentPlan((date(2011, 5, 1), date(2011, 6, 1)), (date(2011, 7, 1),), (date(2011, 8, 1), date(2011, 9, 1)), 90, 30)
    with pytest.raises(ValueError):
        customers.all_samples(facts, plan, date(2011, 3, 1), date(2011, 12, 1))
    model = experiment.train(facts, plan, (date(2011, 1, 1), date(2011, 12, 1)), tmp_path, "release", "f1")
    found = json.loads((tmp_path / model / "evaluation.json").read_text())
    assert {r["candidate"] for r in found["results"]} >= {experiment.BASELINE, found["chosen"]["candidate"]} and experiment.train(facts, plan, (date(2011, 1, 1), date(2011, 12, 1)), tmp_path, "release", "f1") == model
    manifest = publication.verify(Folder.of(spark, tmp_path) / model)
    experiment.compatible(manifest, "release", 90, date(2011, 7, 31), "f1")
    for bad in (("other", 90, date(2011, 7, 31), "f1"), ("release", 91, date(2011, 7, 31), "f1"), ("release", 90, date(2011, 7, 30), "f1"), ("release", 90, date(2011, 7, 31), "f2")):
        with pytest.raises(ValueError):
            experiment.compatible(manifest, *bad)
    features = customers.features(facts, date(2011, 9, 1), 90)
    got = experiment.score(spark, tmp_path, model, features)
    assert got.count() == features.count() and got.where("score < 0 or score > 1").count() == 0
    with pytest.raises(ValueError):
        experiment.score(spark, tmp_path, "../x", features)


def test_selection_breaks_ties_by_id():
    e = lambda c, v: experiment.Evaluation(c, "validation", v, 1, 1, 1.0, 1, 1.0, 1.0, 1.0)
    best, each = experiment.select([e("logistic-0.1", 0.5), e("forest-5", 0.5), e("forest-3", 0.5), e("logistic-0.01", None)])
    assert best.candidate == "forest-3" and [x.candidate for x in each] == ["forest-3", "logistic-0.1"]


def test_command_line(capsys, tmp_path):
    assert cli.main(["generate", "50", str(tmp_path / "e.jsonl")]) == 0 and json.loads(capsys.readouterr().out)["sent"] == len((tmp_path / "e.jsonl").read_text().splitlines()) == 50
    assert cli.main(["version"]) == 0 and len(capsys.readouterr().out.strip()) == 64
    assert cli.main(["plan"]) == 0 and "history_days" in capsys.readouterr().out
    with pytest.raises(SystemExit):
        cli.main(["profile", "only-one-argument"])


def test_command_line_from_workbook_to_profiles(spark, tmp_path, capsys):
    from test_sources import book, cell

    rows = []
    for n in range(2, 42):
        parts = [cell(f"A{n}", 500000 + n), f'<c r="B{n}" t="inlineStr"><is><t>S{n % 4}</t></is></c>', cell(f"D{n}", 1 + n % 5), cell(f"E{n}", 40700 + n, ' s="1"'), cell(f"F{n}", "2.5"), cell(f"G{n}", 17000 + n % 9)]
        rows.append(f'<row r="{n}">' + "".join(parts) + "</row>")
    (tmp_path / "b.xlsx").write_bytes(book(rows))

    def run(*args):
        assert cli.main(["--work", str(tmp_path / "work"), *args]) == 0
        return capsys.readouterr().out.strip()

    source = run("ingest", str(tmp_path / "b.xlsx"))
    assert run("ingest", str(tmp_path / "b.xlsx")) == source
    spark._jsc.hadoopConfiguration().set("fs.viewfs.mounttable.cli.link./w", f"file://{tmp_path}")
    assert cli.main(["--work", "viewfs://cli/w/far", "ingest", str(tmp_path / "b.xlsx")]) == 0 and capsys.readouterr().out.strip() == source
    landings = [workbook.read_landing(spark, f"file://{tmp_path}/{w}/raw/{source}/landing").collect() for w in ("work", "far")]
    assert len(landings[0]) == 40 and landings[0] == landings[1]
    release = run("build", source)
    assert run("build", source) == release and json.loads(run("report", release))["rows"] == 40
    assert run("profile", release, "2011-09-01")
    service = serving.CustomerService(spark, tmp_path / "work" / "customers")
    assert service.page("retail", limit=100).count() == 9
