"""Lines that name a patched source, against every line with every source."""

from __future__ import annotations

import random
from collections import Counter

from lingot.operators.logs import _name_anchors, patched_sources


def _hit(line, cls, resource, path):
    """The conditions as they read, for one line and one source; a null holds nothing."""
    if path is None:
        return False
    path = path.lower()
    line = None if line is None else line.lower()
    if resource and resource.lower() in path:
        return True
    if cls and path.endswith(cls.rsplit("/", 1)[-1].lower() + ".class"):
        return True
    return line is not None and (path in line or path.rsplit("/", 1)[-1] in line)


def test_patched_sources_against_all_pairs(spark):
    dice = random.Random(5)
    word = lambda n: "".join(dice.choice("aBc/.") for _ in range(dice.randint(0, n)))
    issues = [(i % 4, dice.choice([None, word(30), word(30), "x/aBc.class " + word(9)]), dice.choice([None, "", word(6), "g/aB"]), dice.choice([None, "", word(4), word(12)])) for i in range(150)]
    paths = [None, "", "a", "res/", "q/aB.class", "aabb/ccAB.class", "assets/a long name of an icon.png"] + [word(14) for _ in range(40)]
    issues += issues[:9] + [(7, "no such ICON: A Long Name of an icon.png!", "", "")]
    paths += paths[:3]
    log = spark.createDataFrame(issues, "log_id int, line string, class_name string, resource string")
    sources = spark.createDataFrame([(p,) for p in paths], "path string")
    got = Counter(map(tuple, patched_sources(log, sources).collect()))
    assert got == Counter((*i, p) for i in issues for p in paths if _hit(*i[1:], p)) and len(got) > 300
    assert patched_sources(log.limit(0), sources).count() == 0 and patched_sources(log, sources.limit(0)).count() == 0


def test_patched_sources_joins_on_equality(spark):
    log = spark.createDataFrame([(1, "res/a.png", "", "")], "log_id int, line string, class_name string, resource string")
    plan = patched_sources(log, spark.createDataFrame([("res/a.png",)], "path string"))._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_names_that_begin_alike_part(spark):
    names = [f"icon_of_the_game_{i:03}.png" for i in range(300)]
    paths = spark.createDataFrame([(n,) for n in names] + [("short",), (None,)], "_name string")
    got = {r._name: r._rarest for r in _name_anchors(paths).collect()}
    assert set(got) == set(names) and all(a in n and len(a) == 8 for n, a in got.items())
    assert max(Counter(got.values()).values()) == 1
