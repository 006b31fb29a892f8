"""Adjustments of a pair's score by the families of its archetypes, as decision tables.

Fixed values: archetypes, axes, values and amounts (in hundredths) have to be
the ones that scores were tuned with.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import decisions
from .decisions import AtLeast, Flag, Has, Kind, Rule

OPEN, MMO, SOULS, WESTERN, CINEMATIC, OPEN_ADVENTURE = "open_world_fantasy_action_rpg", "mmo_action_rpg", "soulslike_action_rpg", "western_narrative_rpg", "cinematic_action_adventure", "open_world_action_adventure"


def _to(*kinds: str) -> Kind:
    return Kind("candidate", kinds)


_builds = Has("anchor", "entity_interaction", ("construction_placement",)) | Has("anchor", "rules_goals", ("build_and_optimize",)) | Has("anchor", "progression_model", ("base_growth",))
#: Anchors that ride and build; others that climb or glide alone.
FRONTIER = Kind("anchor", (OPEN,)) & Has("anchor", "traversal_verbs", ("horseback",)) & _builds
EXPLORER = Kind("anchor", (OPEN,)) & ~FRONTIER & Has("anchor", "traversal_verbs", ("climbing", "gliding")) & ~Has("anchor", "world_topology", ("persistent_shared_world",)) & ~Has("anchor", "mode_profile", ("mmo",))
SOULSLIKE = Kind("anchor", (SOULS,))

_world, _setting, _rules = Has("shared", "world_topology"), Has("shared", "setting"), Has("shared", "rules_goals")
_entities, _progress, _travel = Has("shared", "entity_interaction"), Has("shared", "progression_model"), Has("shared", "traversal_verbs")
_quests, _bosses, _souls = Has("shared", "rules_goals", ("complete_quests",)), Has("shared", "rules_goals", ("defeat_bosses",)), Has("shared", "challenge_model", ("soulslike",))
_dialogue = Has("shared", "entity_interaction", ("dialogue_choice",))
_built = Has("shared", "entity_interaction", ("construction_placement",)) | Has("shared", "rules_goals", ("build_and_optimize",)) | Has("shared", "progression_model", ("base_growth",)) | Flag("shared_studio")

#: Views of a candidate for anchors of the soulslike family.
THIRD_PERSON = Has("candidate", "perspective", ("third_person",)) | Has("candidate", "visual_presentation", ("third_person_3d",))
OTHER_VIEW = Has("candidate", "perspective", ("isometric", "tactical_overhead", "top_down", "side_scrolling", "first_person")) | Has("candidate", "visual_presentation", ("side_scrolling_2d",))
_prefers_third = Has("anchor", "perspective", ("third_person",)) | Has("anchor", "visual_presentation", ("third_person_3d",))

#: Of each table the first row that holds counts.
TABLES = [
    [Rule("explorer: shared online world", EXPLORER & _to(MMO), -12)],
    [Rule("explorer: persistent world", EXPLORER & Has("candidate", "world_topology", ("persistent_shared_world",)), -4)],
    [Rule("explorer: cinematic of the same setting", EXPLORER & _to(CINEMATIC) & _setting & (_bosses | _quests | _progress | Has("shared", "combat_style")), 14)],
    [Rule("explorer: soulslike", EXPLORER & _to(SOULS) & (_souls | _bosses), 10)],
    [Rule("explorer: western", EXPLORER & _to(WESTERN) & (_quests | _dialogue), 10)],
    [Rule("explorer: other family", EXPLORER & ~_to(OPEN, WESTERN, SOULS, CINEMATIC), -14)],
    [Rule("frontier: builders online", FRONTIER & _to(MMO) & _world & _setting & _built, 10)],
    [Rule("frontier: western quests", FRONTIER & _to(WESTERN) & _quests, 14)],
    [Rule("frontier: western choices", FRONTIER & _to(WESTERN) & _dialogue, 10)],
    [Rule("frontier: soulslike challenge", FRONTIER & _to(SOULS) & _souls, 8)],
    [Rule("frontier: soulslike bosses", FRONTIER & _to(SOULS) & _bosses, 6)],
    [Rule("frontier: same world online", FRONTIER & _to(MMO) & _world & _setting & (_travel | _entities | _rules), 8)],
    [Rule("frontier: adventures", FRONTIER & _to(CINEMATIC, OPEN_ADVENTURE), -18)],
    [Rule("frontier: other family", FRONTIER & ~_to(OPEN, WESTERN, SOULS, MMO), -12)],
    [Rule("soulslike: same", SOULSLIKE & _to(SOULS), 8), Rule("soulslike: second", SOULSLIKE & Flag("second_soulslike"), 3), Rule("soulslike: open world", SOULSLIKE & _to(OPEN), -8)],
    [Rule("soulslike: other view", SOULSLIKE & OTHER_VIEW, -28), Rule("soulslike: no third person", SOULSLIKE & _prefers_third & ~THIRD_PERSON, -14), Rule("soulslike: same view", SOULSLIKE & Has("shared", "perspective"), 5)],
    [Rule("soulslike: dark", SOULSLIKE & Has("shared", "setting", ("dark_fantasy",)), 4)],
    [Rule("soulslike: bosses", SOULSLIKE & _bosses, 3)],
    [Rule("soulslike: unlike", SOULSLIKE & ~_souls & ~_to(SOULS), -4)],
    [Rule("no breakdown", Flag("no_breakdown"), -5)],
]

#: The lane of an open-world anchor's own family: tenths for each shared value, and what keeps a candidate out.
LANE_WEIGHTS = {"world_topology": 30, "setting": 20, "perspective": 15, "rules_goals": 20, "entity_interaction": 20, "progression_model": 15, "traversal_verbs": 15, "combat_style": 15, "combat_structure": 15}
_identity = (
    Has("candidate", "combat_style", ("melee", "magic")), Has("candidate", "rules_goals", ("complete_quests", "defeat_bosses", "build_and_optimize")),
    Has("candidate", "progression_model", ("quest_driven", "buildcraft", "skill_tree", "base_growth")), Has("candidate", "traversal_verbs", ("horseback", "climbing", "gliding")),
)
_authored = (Has("candidate", "traversal_verbs", ("horseback", "climbing", "gliding")), Has("candidate", "rules_goals", ("complete_quests",)), Has("candidate", "progression_model", ("quest_driven", "gear_chase")))


def _sandbox(side: str):
    return Has(side, "world_density", ("systemic_sandbox",)) | Has(side, "session_shape", ("sandbox_loop",)) | Has(side, "mode_profile", ("drop_in_coop", "party_coop", "mmo", "pvpve"))


_explored = (Has("candidate", "traversal_verbs", ("climbing", "gliding")), Has("candidate", "rules_goals", ("complete_quests",)), Has("candidate", "progression_model", ("buildcraft", "quest_driven", "skill_tree")), Has("candidate", "challenge_model", ("puzzle_gating",)))
_ridden, _aimed, _handled = Has("candidate", "traversal_verbs", ("horseback", "climbing", "gliding")), Has("candidate", "rules_goals", ("complete_quests", "build_and_optimize")), Has("candidate", "entity_interaction", ("construction_placement", "dialogue_choice"))
_frontier = (_ridden, _aimed, _handled, Has("candidate", "progression_model", ("quest_driven", "base_growth", "buildcraft", "skill_tree")), Has("candidate", "combat_style", ("melee", "magic", "hybrid")))
LANE_REFUSALS = [
    Rule("other family", ~_to(OPEN)),
    Rule("nothing common", ~(_world & _setting & Has("shared", "perspective"))),
    Rule("nothing to do alike", ~(_travel | _rules | _entities | _progress)),
    Rule("party", Has("candidate", "combat_structure", ("party_management",)) & ~Has("shared", "combat_structure")),
    Rule("no identity", ~AtLeast(1, _identity) | (~_travel & ~AtLeast(2, _identity))),
    Rule("sandbox", _sandbox("candidate") & ~_sandbox("anchor") & ~AtLeast(1, _authored)),
    Rule("nothing to explore", EXPLORER & ~AtLeast(1, _explored)),
    Rule("no frontier", FRONTIER & ~(AtLeast(2, _frontier) & (_ridden | _aimed | _handled))),
]
LANE_BONUSES = [Rule("explorer", EXPLORER, 150), *[Rule(f"explorer: {n}", EXPLORER & c, 75) for n, c in enumerate(_explored)], *[Rule(f"frontier: {n}", FRONTIER & c, 80) for n, c in enumerate(_frontier)]]

#: The lane of western narrative candidates for the same anchors.
_quest = (Has("candidate", "rules_goals", ("complete_quests",)), Has("candidate", "entity_interaction", ("dialogue_choice",)), Has("candidate", "progression_model", ("quest_driven",)), Has("candidate", "world_topology", ("open_world",)))
WESTERN_REFUSALS = [
    Rule("other family", ~_to(WESTERN)),
    Rule("nothing common", ~(_setting & Has("shared", "perspective"))),
    Rule("no quests", ~AtLeast(2, _quest)),
    Rule("closed world", ~(_world | Has("candidate", "world_topology", ("open_world",)))),
]
WESTERN_BONUSES = [Rule("western", _to(WESTERN), 150), *[Rule(f"western: {n}", c, 75) for n, c in enumerate(_quest)]]


def adjustment() -> Column:
    """What families add to a pair's score; nothing if a kind is unknown. Reads a, c, a_kind, c_kind, shared_studio, second_soulslike, no_breakdown."""
    return F.when(F.col("a_kind").isNotNull() & F.col("c_kind").isNotNull(), decisions.adjustment(TABLES)).otherwise(0.0)


def own_lane() -> Column:
    return decisions.lane_fit(LANE_REFUSALS, LANE_WEIGHTS, LANE_BONUSES)


def western_lane() -> Column:
    return decisions.lane_fit(WESTERN_REFUSALS, LANE_WEIGHTS, WESTERN_BONUSES)
