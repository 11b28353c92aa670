"""Export writers and readers."""

import csv
import glob
import json
import os
import tempfile

from tidewatch.plans import inputs as I
from tidewatch.sources import exports as X

SF = "/root/testdata/sf0.001"


def test_csv_and_json_exports(spark):
    d = tempfile.mkdtemp(prefix="tw-exp-")
    jobs = I.customer_jobs(spark, SF)
    assert X.export_csv(jobs, f"{d}/full")
    assert not X.export_csv(jobs.limit(0), f"{d}/empty")
    rows = []
    for f in glob.glob(f"{d}/full/*.csv"):
        with open(f, newline="") as fh:
            rows += list(csv.DictReader(fh))
    assert len(rows) == jobs.count() and list(rows[0].keys()) == X.CSV_COLUMNS
    X.export_view_csv(jobs.where("status = 'active'"), f"{d}/view")
    text = "".join(open(f).read() for f in glob.glob(f"{d}/view/*.csv"))
    assert text.startswith('"Company","Title"') or '"Company"' in text
    X.export_view_json(jobs, f"{d}/json")
    n = sum(1 for f in glob.glob(f"{d}/json/*.json") for _ in open(f))
    assert n == jobs.count()


def test_applications_export_and_read(spark):
    d = tempfile.mkdtemp(prefix="tw-apps-")
    apps = I.applications(spark, SF)
    X.export_applications(apps, f"{d}/out", "2024-02-01T00:00:00")
    env = [json.loads(line) for f in glob.glob(f"{d}/out/envelope/*.json") for line in open(f)]
    assert env == [{"version": "1.0.0", "exported_at": "2024-02-01T00:00:00", "application_count": apps.count()}]
    doc = {"version": "1.0.0", "applications": [
        {"id": "a1", "job_id": "c-1", "applied_date": "2024-01-01", "stage": "applied", "notes": "",
         "follow_ups": [{"timestamp": "2024-01-02T00:00:00", "type": "follow-up", "notes": "x"}]}]}
    os.makedirs(f"{d}/in")
    with open(f"{d}/in/apps.json", "w") as fh:
        json.dump(doc, fh)
    with open(f"{d}/in/broken.json", "w") as fh:
        fh.write("{not json")
    got = X.read_applications(spark, f"{d}/in").collect()
    assert [r.id for r in got] == ["a1"] and got[0].follow_ups[0].type == "follow-up"
