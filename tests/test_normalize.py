from pyspark.sql import functions as F

from tidewatch.functions.normalize import create_signature, normalize_location, normalize_title

TITLES = [
    ("Software Engineer", "software engineer"),
    ("  Multiple   Spaces  ", "multiple spaces"),
    ("Sr. Software Engineer", "senior software engineer"),
    ("Jr Developer", "junior developer"),
    ("DevOps Engineer", "development operations engineer"),
    ("QA Engineer", "quality assurance engineer"),
    ("UI/UX Designer", "user interface user experience designer"),
    ("Engineer - Backend", "engineer backend"),
    ("Engineer, Senior", "engineer senior"),
    ("C++ Developer", "c developer"),
    ("Engineer/Developer", "engineer developer"),
    ("Sr./Jr. Engineer", "senior junior engineer"),
    ("", ""),
    (None, ""),
    ("Sr-Engineer", "sr engineer"),
    ("Ingénieur Logiciel", "ingénieur logiciel"),
]

LOCATIONS = [
    ("San Francisco, CA", "san francisco california"),
    ("New York, NY", "new york new york"),
    ("Austin, TX", "austin texas"),
    ("SF", "san francisco"),
    ("NYC", "new york city"),
    ("SF, CA", "san francisco california"),
    ("Remote", "remote"),
    ("Remote - US", "remote"),
    ("Remote (US)", "remote"),
    ("Work from Home", "remote"),
    ("WFH", "remote"),
    ("", "unknown"),
    (None, "unknown"),
    ("Remote, US", "remote us"),
    ("LA", "los angeles"),
    (" Remote - US ", "remote us"),
    ("Washington, DC", "washington washington dc"),
    ("---", "unknown"),
]


def _run(spark, rows, fn):
    df = spark.createDataFrame(rows, "x string, expected string")
    return [(r.x, r.got, r.expected) for r in df.select("x", fn(F.col("x")).alias("got"), "expected").collect()]


def test_title_goldens(spark):
    for x, got, exp in _run(spark, TITLES, normalize_title):
        assert got == exp, (x, got, exp)


def test_location_goldens(spark):
    for x, got, exp in _run(spark, LOCATIONS, normalize_location):
        assert got == exp, (x, got, exp)


def test_signature(spark):
    df = spark.createDataFrame([("acme-corp", "Sr. Software Engineer", "San Francisco, CA")], "c string, t string, l string")
    got = df.select(create_signature(F.col("c"), F.col("t"), F.col("l")).alias("s")).first().s
    assert got == "acme-corp|senior software engineer|san francisco california"


def test_sql_text_path_matches_goldens(spark):
    """``with_signature`` uses the SQL-text form of the same expressions."""
    from tidewatch.functions.normalize import with_signature

    rows = [("acme", t, l) for (t, _), (l, _) in zip(TITLES, LOCATIONS)]
    df = with_signature(spark.createDataFrame(rows, "company_id string, title string, location string"))
    want_t = dict(TITLES)
    want_l = dict(LOCATIONS)
    for r in df.collect():
        assert r.title_norm == want_t[r.title], (r.title, r.title_norm)
        assert r.location_norm == want_l[r.location], (r.location, r.location_norm)
        assert r.signature == f"acme|{r.title_norm}|{r.location_norm}"
        assert r.title_sorted == " ".join(sorted(r.title_norm.split()))
