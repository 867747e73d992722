from __future__ import annotations

import pytest

from millrace.functions.secrets import exposed, redacted


@pytest.mark.parametrize(
    ("text", "gone"),
    [
        ("password=hunter2;sig=abc", ("hunter2", "abc")),
        ("https://a.blob/x?sv=1&sig=Zm9v%2B&se=2", ("Zm9v",)),
        ("AccountKey=abc== and apiToken=x1", ("abc", "x1")),
        ("bearer Q7hX2mK9vT4bN8cR1zL5wP3y failed", ("Q7hX2mK9vT4bN8cR1zL5wP3y",)),
        ("e30a1b2c3d4e5f60718293a4b5c6d7e8f9", ("e30a1b2c",)),
    ],
)
def test_secrets_go(text, gone):
    assert not any(g in redacted(text) for g in gone) and "REDACTED" in redacted(text)


@pytest.mark.parametrize("text", ["/x/retail/orders/ingestion_date=2026-02-03/run_id=r1/orders_20260203.csv", "no such file: part-00000", "monkey business keyword=3 of them", "{{job.start_time.iso_date}} publish_run_summary_of_the_whole_batch2"])
def test_plain_text_stays(text):
    assert redacted(text) == text


def test_documents():
    assert exposed('{"password": "hunter2"}') and exposed("client_secret: 'abc'") and exposed('{"x": "eyJhbGciOiJIUzI1NiIsInR5cCI6.eyJzdWIiOiIxMjM0NTY3ODkwIiwi"}')
    assert exposed("mail some.body@work.org") and not exposed("mail some.body@example.com or a@b")
    assert not exposed('{"password": "{{secrets.x}}", "task_key": "bronze", "timeout_seconds": 600}')
