import json
import threading
from urllib.error import HTTPError
from urllib.request import Request, urlopen

import pytest
from maskwright.config import Settings
from maskwright.operators.search import search
from maskwright.plans.pipeline import AnonymizationPipeline
from maskwright.streaming.jobs import JobStore
from maskwright.streaming.service import serve


def test_jobs_over_http(spark, tmp_path):
    server = serve(JobStore(spark, f"{tmp_path}/jobs"), ["a", "b"], port=0)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    base = f"http://127.0.0.1:{server.server_address[1]}"

    def call(method, path, body=None):
        with urlopen(Request(base + path, method=method, data=None if body is None else json.dumps(body).encode())) as answer:
            return answer.status, json.loads(answer.read() or b"null")

    def status(*args):
        with pytest.raises(HTTPError) as e:
            call(*args)
        return e.value.code

    try:
        assert call("GET", "/jobs") == (200, [])
        code, job = call("POST", "/jobs", {"columns": ["a"], "partner_id": 1, "table_name": "t"})
        assert code == 201 and call("GET", f"/jobs/{job['job_id']}")[1]["columns"] == ["a"]
        assert call("PUT", f"/jobs/{job['job_id']}", {"columns": ["a", "b"]})[1]["columns"] == ["a", "b"]
        assert status("POST", "/jobs", {"columns": ["zzz"], "partner_id": 1, "table_name": "t"}) == 400
        assert status("POST", "/jobs", {"columns": ["a"]}) == 400
        assert status("GET", "/jobs/none") == 404 and status("GET", "/other") == 404 and status("GET", "/jobs/..") == 404
        assert call("DELETE", f"/jobs/{job['job_id']}") == (204, None) and status("DELETE", f"/jobs/{job['job_id']}") == 404
    finally:
        server.shutdown()


def test_rounds_leave_nothing(spark):
    rows = [(f"n{i % 4}", i % 3, f"c{i % 5}") for i in range(60)] + [("rare", 1, "c1")]
    df = spark.createDataFrame(rows, "name string, size int, city string")
    outcome = AnonymizationPipeline(spark, Settings(treatment="suppression", rounds=5)).run(df)
    assert search(outcome.table).sets == []
