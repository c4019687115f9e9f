import io
import json
import urllib.error

import pytest

from tidewarden import cli, providers


def failing(*codes, answer=b'{"incident_id": "i"}'):
    left = list(codes)

    def send(url, body, headers, timeout):
        if left:
            code = left.pop(0)
            raise urllib.error.HTTPError(url, code, "x", {}, io.BytesIO()) if isinstance(code, int) else code
        return answer

    return send


def test_retries_and_waits():
    waits = []
    p = providers.HttpProvider("http://x", transport=failing(503, TimeoutError()), sleeper=waits.append)
    assert p.generate({"incident_id": "i"}) == {"incident_id": "i"} and waits == [0.5, 1.0] and p.counters["retries"] == 2


@pytest.mark.parametrize("codes", [(400,), (503, 503, 503)])
def test_gives_up(codes):
    p = providers.HttpProvider("http://x", transport=failing(*codes), sleeper=lambda s: None)
    with pytest.raises(providers.RequestFailed):
        p.generate({})
    assert p.counters["failures"] == 1


def test_bad_json_fails_at_once():
    p = providers.HttpProvider("http://x", transport=failing(answer=b"<html>"), sleeper=lambda s: pytest.fail("waited"))
    with pytest.raises(providers.RequestFailed):
        p.generate({})


def test_grounding():
    request = {"incident_id": "i", "evidence": [{"reference_id": "a"}]}
    good = {"incident_id": "i", "cited_evidence": [{"reference_id": "a"}], "hypotheses": [{"citations": ["a"]}]}
    assert providers.grounded(request, good) == good
    for change in ({"incident_id": "j"}, {"cited_evidence": []}, {"cited_evidence": [{"reference_id": "a"}, {"reference_id": "b"}]}):
        with pytest.raises(providers.NotGrounded):
            providers.grounded(request, {**good, **change})
    with pytest.raises(providers.NotConfigured):
        providers.investigate(request, None)


def test_cli(spark, tmp_path):
    (tmp_path / "e.jsonl").write_text("\n".join(json.dumps({"event_id": f"00000000-0000-4000-8000-00000000000{i}", "timestamp": f"2026-01-01T00:0{i}:00Z", "actor_id": "alice", "actor_type": "user", "action": a, "resource": r, "result": x}) for i, (a, r, x) in enumerate([("login", "console", "failure"), ("login", "console", "success"), ("role_change", "admin-console", "success")])))
    found = json.loads(cli.main(["incidents", str(tmp_path / "e.jsonl")]))["incidents"]
    assert [(i["fingerprint"], i["severity"]) for i in found] == [("alice:admin-console", "high"), ("alice:console", "medium"), ("sequence:credential_attack:alice", "critical")]
    assert len(found[2]["event_ids"]) == 3
    (tmp_path / "v.json").write_text(json.dumps([{"reference_type": "event", "reference_id": "e1", "source": "s"}]))
    assert "Credential compromise response" in cli.demo(spark, str(tmp_path / "v.json"))
