"""Model answers to records."""

import json

import pytest
from pyspark.sql import functions as F

from candidata.inference.client import OfflineClient, infer, infer_attempts, readable
from candidata.inference.prompts import fit_instructions
from candidata.operators import records
from candidata.schemas import ANSWER, FIT_REQUIRED


@pytest.mark.parametrize(
    "answer, cleaned",
    [
        ('```json\n{"a": 1}\n```', '{"a": 1}'),
        ('Sure:\n```json\n{"a": {"b": 2}}\n``` done', '{"a": {"b": 2}}'),
        ("no braces ``` \n", "no braces "),
        ('{"a": 1} and {"b": 2}', '{"a": 1} and {"b": 2}'),
        ("} before {", "} before {"),
        ("", ""),
        (None, None),
    ],
)
def test_clean_json(one, answer, cleaned):
    assert one(records.clean_json(F.col("v").cast("string")), v=answer) == cleaned


@pytest.mark.parametrize(
    "text, valid",
    [
        ('{"a": 1}', True),
        ('{"a": 1} and {"b": 2}', False),
        ('{"a": 1}, {"b": 2}', False),
        ("{'a': 1}", False),
        ('{"a": 1', False),
        ("[1]", False),
        ("", False),
        (None, False),
        ('{"a": "line\\nbreak", "b": [null, true, 1e3]}', True),
        ('{"a": "line\nbreak"}', False),
    ],
)
def test_is_json_object(one, text, valid):
    assert one(records.is_json_object(F.col("v").cast("string")), v=text) is valid


@pytest.mark.parametrize(
    "text, complete",
    [
        ('{"summary": null, "fit_percentage": null, "key_matches": null, "key_gaps": null}', True),
        ('{"summary": "", "fit_percentage": 1, "key_matches": []}', False),
        ("{}", False),
        ("nothing", False),
    ],
)
def test_has_required(one, text, complete):
    assert one(records.has_required(F.col("v"), FIT_REQUIRED), v=text) is complete


def test_attempts(spark):
    data = [
        ("second", 1, False, "bad"),
        ("second", 2, True, "good"),
        ("second", 3, True, "better"),
        ("parse", 1, False, None),
        ("parse", 2, False, "x"),
        ("parse", 3, False, "y" * 600),
        ("silent", 1, False, "x"),
        ("silent", 2, False, "x"),
        ("silent", 3, False, None),
        ("short", 1, False, "x"),
        ("late", 4, True, "too late"),
    ]
    df = spark.createDataFrame(data, "key string, n int, ok boolean, raw string").repartition(4)
    df = df.withColumn("json", F.upper("raw"))
    got = {r["key"]: r for r in records.resolve_attempts(df, "key", "n", "ok", "raw", ["json"]).collect()}
    assert (got["second"]["attempt"], got["second"]["json"], got["second"]["error"]) == (2, "GOOD", None)
    assert got["parse"]["error"] == records.PARSE_FAILED and got["parse"]["raw_response"] == "y" * 500
    assert got["silent"]["error"] == records.NO_ATTEMPT_WORKED and got["silent"]["raw_response"] is None
    assert got["short"]["error"] == records.NO_ATTEMPT_WORKED
    assert set(got) == {"second", "parse", "silent", "short"}


def test_clean_record_fills_what_is_missing(spark):
    answers = [
        json.dumps({"personal_info": {"email": "at a.b@c.org!", "phone": ""}, "skills": ["x", " x "]}),
        json.dumps({"skills": None, "personal_info": None}),
    ]
    df = spark.createDataFrame([(a,) for a in answers], "json string").withColumn("raw", F.col("json"))
    parsed = records.parse_record(df.coalesce(1), "json", "raw", ANSWER).select("record.*")
    first, second = records.clean_record(parsed).collect()
    assert first["personal_info"]["email"] == "a.b@c.org" and first["personal_info"]["phone"] == ""
    assert first["skills"] == ["X", "X"] and first["languages"] == []
    assert second["skills"] == [] and second["personal_info"]["name"] == ""


def test_failed_calls_are_null(spark):
    class Failing:
        def __call__(self, prompt, provider, model):
            if "bad" in prompt:
                raise TimeoutError
            return OfflineClient()(prompt, provider, model)

    df = spark.createDataFrame([("good", "p2", "m1"), ("bad", "p2", "m1"), (None, "p2", "m1")], "prompt string, provider string, model string")
    rows = {r["prompt"]: r for r in infer(df, Failing).collect()}
    assert rows["bad"]["body"] is None and rows["bad"]["call_error"] == "TimeoutError: "
    assert rows[None]["body"] is None and rows[None]["call_error"] is None
    answer = json.loads(json.loads(rows["good"]["body"])["choices"][0]["message"]["content"])
    assert answer["summary"] == "m1 read 4 characters" and rows["good"]["call_error"] is None


def test_attempts_end_with_the_first_readable_answer(spark):
    class Counting:
        def __call__(self, prompt, provider, model):
            if model == "broken":
                raise ValueError("no key")
            if model == "silent":
                return None
            return OfflineClient().envelope({"prose": "nothing here", "half": '{"a": 1', "good": '{"a": 1}'}[model], provider)

    steps = lambda *models: [("p2", m) for m in models]
    rows = [
        ("x", steps("broken", "good", "prose")), ("y", steps("broken", "silent")), ("z", steps("half", "prose")), ("n", []), (None, steps("good")), ("e", None),
    ]
    df = spark.createDataFrame(rows, "prompt string, attempts array<struct<provider:string,model:string>>")
    answered = infer_attempts(df, Counting, ["p2"])
    got = answered.withColumn("r", records.resolve_answers(F.col("answers"), ["p2"], records.is_json_object)).collect()
    got = {r["prompt"]: (len(r["answers"]), r["r"]) for r in got}
    assert got["x"][0] == 2 and got["x"][1]["success"] and got["x"][1]["model"] == "good" and got["x"][1]["cause"] is None
    assert (got["y"][1]["error"], got["y"][1]["cause"]) == (records.NO_ATTEMPT_WORKED, "no answer")
    assert (got["z"][1]["error"], got["z"][1]["raw_response"]) == (records.PARSE_FAILED, "nothing here")
    assert all(got[k][0] == 0 and got[k][1]["error"] == records.ALL_EXHAUSTED for k in ("n", None, "e"))


def test_instructions_need_an_option(one):
    assert one(fit_instructions({"required_skills": F.col("v").cast("string")}), v=None) == ""
    lines = one(fit_instructions({"min_experience": F.col("v")}), v="3").splitlines()
    assert lines[0] == "EVALUATION GUIDELINES:" and len(lines) == 4
    assert "'Meets minimum experience requirement (3+ years)'" in lines[2]

def test_lists_of_other_shapes_are_kept(spark):
    answer = {
        "experience": ["did x", {"title": "a", "company": 3}, None],
        "education": "BSc",
        "skills": "one, two",
        "languages": {"language": "fr"},
        "projects": ["site", {"name": "app", "technologies": "Python"}],
        "personal_info": "Ann",
        "awards": ["[first]", 2],
        "summary": 5,
    }
    df = spark.createDataFrame([(json.dumps(answer),)], "j string")
    got = df.select(records.parse_loosely(F.col("j"), ANSWER).alias("r")).first()["r"].asDict(True)
    assert [e and e["title"] for e in got["experience"]] == ["did x", "a", None]
    assert got["experience"][0]["company"] == "" and got["experience"][1]["company"] == "3"
    assert [e["degree"] for e in got["education"]] == ["BSc"]
    assert got["personal_info"]["name"] == "Ann" and got["personal_info"]["email"] == ""
    assert got["projects"][0]["technologies"] == [] and got["projects"][1]["technologies"] == ["Python"]
    assert got["projects"][1]["description"] == "" and got["experience"][1]["duration"] == ""
    assert got["skills"] == ["one, two"] and got["languages"][0]["language"] == "fr"
    assert got["projects"][0] == {"name": "site", "description": "", "technologies": [], "duration": ""}
    assert got["awards"] == ["[first]", "2"] and got["summary"] == "5"
    assert got["certifications"] is None


TEXTS = [
    '{"a": 1}', '{"a": NaN}', '{"a": Infinity}', '{"a": -Infinity}', '{"a": 1, "a": 2}', '{"a": {"b": 1, "b": 1}}', '[{"a": 1, "a": 2}]',
    '{"a": 1} {"b": 2}', '```json\n{"a": 1}\n```', 'x {"a": [1, {"b": null}]} y', '{"a": 1', "", "{}", "{'a': 1}", '{"a": 01}', '{"a": 1e5}',
    '{"a": "\\u0041"}', '{"a": "two\nlines"}', '{"a": tru}', '{"a": 1,}', '{"a" 1}', "null", '{"a": "}"}', '{"a": 123456789012345678901234567890}',
]


def test_both_sides_agree_on_a_valid_answer(spark):
    """The worker stops asking exactly at the answers that are kept later."""
    bodies = [(i, OfflineClient().envelope(t, p), p) for p in ("p1", "p2") for i, t in enumerate(TEXTS)]
    bodies += [(90, OfflineClient().envelope('{"a": 1}', "p1"), "p2"), (91, OfflineClient().envelope('{"a": 1}', "p2"), "p1")]
    bodies += [(92, '{"choices": [{"message": {"content": null}}]}', "p2"), (93, '{"choices": [{"message": {"content": {"a": 1}}}]}', "p2")]
    bodies += [(94, "no json", "p1"), (95, None, "p1"), (96, "[]", "p2"), (97, '{"choices": []}', "p2")]
    df = spark.createDataFrame(bodies, "i int, body string, provider string")
    text = records.clean_json(records.unwrap_response(F.col("body"), F.col("provider"), ["p2"]))
    found = df.select("i", "body", "provider", records.is_json_object(text).alias("valid")).collect()
    differ = [(r["i"], r["body"]) for r in found if r["valid"] != readable(r["body"], r["provider"] == "p2")]
    assert differ == []
    assert {r["i"] for r in found if r["valid"]} >= {0, 8, 9, 12, 15, 16, 93}
    assert not {r["i"] for r in found if r["valid"]} & {1, 2, 3, 4, 5, 90, 91, 92, 94, 95, 96, 97}
