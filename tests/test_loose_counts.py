"""Outcomes of old exchange files, counted without listing the strings of an original."""

from __future__ import annotations

import json
import random
from collections import Counter

from lingot.operators import memory
from lingot.sources import exchange

STRINGS = "key string, value string"


def test_counts_are_those_of_the_listed_rows(spark):
    dice = random.Random(3)
    values = ["Go %d", "Exit", "Stop {0} %s", "", "same", "one \\n"]
    strings = spark.createDataFrame([(f"k{i}", dice.choice(values)) for i in range(30)] + [("lone", "lone %d")], STRINGS)
    existing = spark.createDataFrame([(f"k{i}", dice.choice(["old", " "])) for i in range(0, 30, 3)], "key string, translation string")
    said = lambda: dice.choice([None, 5, " ", "vi", "vi %d", "{0} %s x %s", "%s {0}", "\\n"])
    item = lambda: dice.choice([7, {"key": dice.choice([f" k{dice.randint(0, 40)} ", "", None]), "original": dice.choice([*values, "lone %d", None]), "translation": said()}])
    texts = [json.dumps([item() for _ in range(25)]) for _ in range(4)] + [json.dumps({"items": [item() for _ in range(25)]}) for _ in range(4)]
    texts += ["{" + ",".join(f"{json.dumps(dice.choice([*values, 'lone %d', 'none']))}: {json.dumps(said())}" for _ in range(n)) + "}" for n in (1, 3, 9, 9, 20)]
    rows = exchange.read_payloads(spark.createDataFrame(list(enumerate(texts)), "file_id long, json string"))
    for overwrite in (False, True):
        listed = memory.validate_items(rows.where("form in ('v1', 'list')"), strings, existing, overwrite).select("file_id", "form", "outcome")
        listed = listed.unionByName(memory.validate_dictionary(rows.where("form = 'dictionary'"), strings, existing, overwrite).select("file_id", "form", "outcome"))
        got = {tuple(r)[:3]: r.n for r in memory.loose_counts(rows, strings, existing, overwrite).collect()}
        assert got == Counter(map(tuple, listed.collect())) and len(got) > 25


def test_strings_of_an_original_are_not_listed(spark):
    # 30 dictionaries name a value that 300 strings have: 9,000 pairs of entry and string
    rows = spark.range(30).selectExpr("id as file_id", "'dictionary' as form", "0 as pos", "cast(null as array<string>) as present", "cast(null as string) as key", "'same' as original", "'vi' as translation")
    strings = spark.range(300).selectExpr("'k' || id as key", "'same' as value")
    told = memory.loose_counts(rows, strings, strings.where("key like 'k1%'").selectExpr("key", "value as translation"))
    assert Counter((r.outcome, r.n) for r in told.collect()) == {("imported", 189): 30, ("skipped_existing", 111): 30}
    metrics, nodes = [], [told._jdf.queryExecution().executedPlan()]
    while nodes:
        node = nodes.pop()
        if "numOutputRows" in str(node.metrics()):
            metrics.append(node.metrics().apply("numOutputRows").value())
        inner = node.executedPlan() if node.getClass().getSimpleName() == "AdaptiveSparkPlanExec" else node.plan() if node.getClass().getSimpleName().endswith("QueryStageExec") else None
        children = node.children()
        nodes += [inner] if inner is not None else [children.apply(i) for i in range(children.size())]
    assert metrics and max(metrics) <= 330


def test_repeated_names_of_dictionaries_of_any_size(spark):
    pairs = [("a", "1"), ("b", 2), ("a", "3"), ("c", None)]
    text = lambda more: "{" + ",".join(f"{json.dumps(k)}:{json.dumps(v)}" for k, v in [*pairs, *more]) + "}"
    long = [("n" * (exchange.LONGEST_NAME + 1), "x")]
    rows = exchange.read_payloads(spark.createDataFrame([(1, text([])), (2, text(long)), (3, '{"a":"1","b":"2"}')], "file_id long, json string"))
    got = {(r.file_id, r.original[:1]): (r.pos, r.translation) for r in rows.collect()}
    assert rows.count() == len(got) == 9
    assert got == {(f, k): v for f in (1, 2) for k, v in {"a": (0, "3"), "b": (1, None), "c": (3, None)}.items()} | {(2, "n"): (4, "x"), (3, "a"): (0, "1"), (3, "b"): (1, "2")}
