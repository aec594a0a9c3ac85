"""Every run of a word is a finding, and rare secrets reach the training sample."""
import hashlib

from routekit.llm import secrets


def digest(k):
    return hashlib.sha1(str(k).encode()).hexdigest()


def test_every_run_of_a_word(spark):
    a, b = digest(1), digest(2)
    made = [(1, f'{{"name":"nothing_to_see_in_here","token":"{a}","secret":"{b}"}}'), (2, f"see https://example.com/search?session={a}&page=1&key={b} now"), (3, f'"{a}","{a}"')]
    got = sorted((r.doc_id, r.at, r.run, r.found) for r in secrets.candidates(spark.createDataFrame(made, "doc_id long, text string")).collect())
    assert got == [(1, 0, 1, a), (1, 0, 2, b), (2, 1, 1, f"session={a}"), (2, 1, 2, f"key={b}"), (3, 0, 0, a), (3, 0, 1, a)]


def test_rare_secrets_reach_the_sample(spark, monkeypatch):
    monkeypatch.setattr(secrets, "TRAINING", 8)
    made = [(k, f"number {1000000000000000 + k * 77777} of many") for k in range(300)] + [(1000, f'token = "{digest(3)}" then')]
    got = secrets.scan(spark.createDataFrame(made, "doc_id long, text string"))
    assert {r.doc_id for r in got.where("secret").collect()} == {1000}
