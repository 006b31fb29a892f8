"""Decision tables: modes of reading, and the families' seeds."""

import random

from pyspark.sql import functions as F

from gapline.operators import decisions, families
from gapline.operators.decisions import All, Any, AtLeast, Flag, Has, Kind, Not, Rule

SCHEMA = "name string, a map<string,array<string>>, c map<string,array<string>>, a_kind string, c_kind string, shared_studio boolean"
OPEN, MMO, SOULS, WESTERN = families.OPEN, families.MMO, families.SOULS, families.WESTERN


def scored(spark, rows, **columns):
    df = spark.createDataFrame(rows, SCHEMA).withColumns({"second_soulslike": F.lit(False), "no_breakdown": F.lit(None).cast("boolean")})
    return {r.name: r for r in df.select("name", *[c.alias(n) for n, c in columns.items()]).collect()}


def holds(c, a, k, flags):
    """The condition read plainly."""
    axes, kinds = {"anchor": a[0], "candidate": a[1]}, {"anchor": k[0], "candidate": k[1]}
    if isinstance(c, Has):
        of = lambda side: set((axes[side] or {}).get(c.axis) or ())
        found = of("anchor") & of("candidate") if c.side == "shared" else of(c.side)
        return bool(found & set(c.values)) if c.values else bool(found)
    if isinstance(c, Kind):
        return kinds[c.side] in c.kinds
    if isinstance(c, Flag):
        return bool(flags.get(c.name))
    if isinstance(c, Not):
        return not holds(c.part, a, k, flags)
    some = [holds(p, a, k, flags) for p in c.parts]
    return all(some) if isinstance(c, All) else any(some) if isinstance(c, Any) else sum(some) >= c.least


def test_tables_equal_their_plain_reading(spark):
    rng = random.Random(9)
    pools = {
        "world_topology": ["open_world", "persistent_shared_world", "linear"], "setting": ["high_fantasy", "dark_fantasy", "mythic"], "rules_goals": ["complete_quests", "defeat_bosses", "build_and_optimize"],
        "traversal_verbs": ["horseback", "climbing", "swimming"], "entity_interaction": ["construction_placement", "dialogue_choice", "x"], "progression_model": ["base_growth", "quest_driven", "y"], "perspective": ["third_person", "isometric"],
        "challenge_model": ["soulslike", "z"], "combat_style": ["melee", "guns"], "combat_structure": ["party_management", "boss_centric"], "mode_profile": ["mmo", "single_player"], "session_shape": ["sandbox_loop", "short"],
    }
    one = lambda: rng.choice([None, {}] + [{x: rng.choice([None, *[rng.choices(v, k=rng.randint(0, 3)) for _ in range(5)]]) for x, v in pools.items()} for _ in range(12)])
    kinds = [None, OPEN, OPEN, OPEN, MMO, SOULS, WESTERN, families.CINEMATIC, "other"]
    rows = [(str(n), one(), one(), rng.choice(kinds), rng.choice(kinds), rng.choice([True, False, None])) for n in range(1500)]
    tables, every = families.TABLES, [r for t in families.TABLES for r in t]
    kind = [Rule("1", families.FRONTIER, "frontier"), Rule("2", families.EXPLORER, "explorer")]
    got = scored(spark, rows, adjustment=families.adjustment(), reasons=decisions.reasons(every), mode=decisions.first(kind, "generic"), lane=families.own_lane(), western=families.western_lane(), hits=decisions.hits(families._explored))
    seen = set()
    for name, a, c, x, y, studio in rows:
        test = lambda rule, a=a, c=c, x=x, y=y, studio=studio: holds(rule.when, (a, c), (x, y), {"shared_studio": studio})
        want = sum(next((r.value for r in t if test(r)), 0) for t in tables) / 100 if x and y else 0.0
        assert (got[name].adjustment, got[name].reasons) == (want, [r.name for r in every if test(r)])
        assert got[name].mode == next((r.value for r in kind if test(r)), "generic")
        shared = lambda axis, a=a, c=c: len(set((a or {}).get(axis) or ()) & set((c or {}).get(axis) or ()))
        for lane, refusals, bonuses in (("lane", families.LANE_REFUSALS, families.LANE_BONUSES), ("western", families.WESTERN_REFUSALS, families.WESTERN_BONUSES)):
            fit = None if any(map(test, refusals)) else (sum(shared(axis) * w * 10 for axis, w in families.LANE_WEIGHTS.items()) + sum(r.value for r in bonuses if test(r))) / 100
            assert got[name][lane] == fit
            seen.add((lane, fit is None))
    assert len(seen) == 4


def test_seeds(spark):
    zelda = {"world_topology": ["open_world"], "perspective": ["third_person"], "traversal_verbs": ["climbing", "gliding"], "setting": ["high_fantasy", "mythic"], "mode_profile": ["single_player"]}
    online = {"world_topology": ["open_world", "persistent_shared_world"], "perspective": ["third_person"], "setting": ["high_fantasy", "mythic"], "rules_goals": ["build_and_optimize"], "mode_profile": ["mmo"]}
    ring = {"world_topology": ["open_world"], "perspective": ["third_person"], "combat_structure": ["boss_centric"], "challenge_model": ["soulslike"], "rules_goals": ["defeat_bosses"], "setting": ["dark_fantasy", "mythic"]}
    blood = {"perspective": ["third_person"], "combat_structure": ["boss_centric"], "challenge_model": ["soulslike"], "rules_goals": ["defeat_bosses"], "setting": ["dark_fantasy", "horror"]}
    desert = {"world_topology": ["open_world"], "perspective": ["third_person"], "traversal_verbs": ["horseback", "gliding"], "challenge_model": ["soulslike"], "rules_goals": ["defeat_bosses", "complete_quests"], "setting": ["dark_fantasy", "mythic"]}
    rows = [("online", zelda, online, OPEN, MMO, None), ("blood", ring, blood, SOULS, SOULS, None), ("desert", ring, desert, SOULS, OPEN, None), ("unknown", ring, blood, SOULS, None, None)]
    got = scored(spark, rows, adjustment=families.adjustment(), lane=families.own_lane())
    assert got["online"].adjustment == -0.30 and got["blood"].adjustment > got["desert"].adjustment and got["unknown"].adjustment == 0
    assert got["online"].lane is None


def test_empty_tables(spark):
    got = scored(spark, [("x", {}, {}, "k", "k", None)], a=decisions.adjustment([]), t=decisions.total([]), f=decisions.first([], "none"), l=decisions.lane_fit([], {"w": 1}, []), n=F.when(AtLeast(1, ()).column(), 1).otherwise(0))
    assert tuple(got["x"])[1:] == (0.0, 0, "none", 0.0, 0)
