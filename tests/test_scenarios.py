"""The reference's labelled repost scenarios (FIXTURES 3.3): originals observed on
2024-01-01 12:00, variants on 2024-01-15 12:00. Each scenario runs in its own company block
(company id prefixed with the scenario name), so state does not accumulate across scenarios.
Expected by the code: 6/6 reposts detected; 5/6 new postings kept new (hybrid_vs_remote
scores 0.9512 and is reported as a repost)."""

from datetime import datetime

from pyspark.sql import functions as F

from tidewatch.functions.normalize import with_signature
from tidewatch.operators.classify import ENTITY_COLUMNS, run_cycle
from tidewatch.operators.metrics import evaluate

# (name, company, original title, original location, variant company, variant title, variant location, is_repost)
SCENARIOS = [
    ("exact_repost", "test-co", "Senior Software Engineer", "San Francisco, CA", "test-co", "Senior Software Engineer", "San Francisco, CA", True),
    ("title_abbreviation", "test-co", "Senior Software Engineer", "San Francisco, CA", "test-co", "Sr. Software Engineer", "San Francisco, CA", True),
    ("location_format", "test-co", "Data Scientist", "San Francisco, California", "test-co", "Data Scientist", "San Francisco, CA", True),
    ("different_seniority", "test-co", "Software Engineer", "Remote", "test-co", "Senior Software Engineer", "Remote", False),
    ("different_location", "test-co", "Product Manager", "New York, NY", "test-co", "Product Manager", "San Francisco, CA", False),
    ("punctuation_variation", "test-co", "Machine Learning Engineer - Computer Vision", "Seattle, WA", "test-co", "Machine Learning Engineer (Computer Vision)", "Seattle, WA", True),
    ("remote_to_location", "test-co", "Backend Engineer", "Remote", "test-co", "Backend Engineer", "Remote - US", True),
    ("completely_different", "test-co", "Software Engineer", "Boston, MA", "test-co", "Marketing Manager", "Boston, MA", False),
    ("word_order", "test-co", "Research Engineer - Machine Learning", "Palo Alto, CA", "test-co", "Machine Learning Research Engineer", "Palo Alto, CA", True),
    ("specialization_added", "test-co", "Software Engineer", "Austin, TX", "test-co", "Software Engineer - Infrastructure", "Austin, TX", False),
    ("different_company_entity", "test-co", "DevOps Engineer", "Chicago, IL", "test-co-labs", "DevOps Engineer", "Chicago, IL", False),
    ("hybrid_vs_remote", "test-co", "Full Stack Engineer", "Hybrid - Seattle, WA", "test-co", "Full Stack Engineer", "Seattle, WA", False),
]
BATCH_SCHEMA = ("batch_seq bigint, company_id string, company_name string, title string, location string, url string, "
                "source_identifier string, department string, description string")
ENTITY_SCHEMA = (
    "id string, entity_seq bigint, company_id string, company_name string, title string, location string, url string, "
    "classification string, classification_reasoning string, status string, first_seen timestamp_ntz, "
    "last_seen timestamp_ntz, source_identifier string, department string, description string, "
    "created_at timestamp_ntz, updated_at timestamp_ntz"
)


def test_labelled_scenarios(spark):
    originals = [(i, f"{s[0]}/{s[1]}", "TestCo", s[2], s[3], f"https://x/o{i}", f"orig-{i}", None, None)
                 for i, s in enumerate(SCENARIOS)]
    variants = [(i, f"{s[0]}/{s[4]}", "TestCo", s[5], s[6], f"https://x/t{i}", f"test-{i}", None, None)
                for i, s in enumerate(SCENARIOS)]
    empty = with_signature(spark.createDataFrame([], ENTITY_SCHEMA)).select(*ENTITY_COLUMNS)
    first = run_cycle(empty, spark.createDataFrame(originals, BATCH_SCHEMA), datetime(2024, 1, 1, 12), run_id="s1")
    second = run_cycle(first.entities, spark.createDataFrame(variants, BATCH_SCHEMA), datetime(2024, 1, 15, 12), run_id="s2")
    got = {r.batch_seq: r.decision for r in second.decisions.collect()}
    labels = spark.createDataFrame(
        [(bool(s[7]), got[i] == "repost") for i, s in enumerate(SCENARIOS)], "expected boolean, predicted boolean")
    m = evaluate(labels).first()
    assert (m.true_positives, m.expected_positive) == (6, 6)
    assert (m.false_positives, m.expected_negative) == (1, 6)
    assert abs(m.new_accuracy - 5 / 6) < 1e-12 and m.detection_rate == 1.0
    wrong = [SCENARIOS[i][0] for i in got if (got[i] == "repost") != SCENARIOS[i][7]]
    assert wrong == ["hybrid_vs_remote"]
    # determinism: the same inputs give the same decisions and ids
    again = run_cycle(first.entities, spark.createDataFrame(variants, BATCH_SCHEMA), datetime(2024, 1, 15, 12), run_id="s2")
    assert sorted(map(tuple, again.decisions.select("batch_seq", "decision", "entity_id", "target_id").collect())) == \
        sorted(map(tuple, second.decisions.select("batch_seq", "decision", "entity_id", "target_id").collect()))
    # every repost carries a reason
    reasons = second.entities.where(F.col("classification") == "repost").select("classification_reasoning").collect()
    assert reasons and all(r[0].startswith("Likely repost of job ") for r in reasons)
