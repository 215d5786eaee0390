"""Entity and relation types as constants and as small dimension columns."""
from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Types, endpoint rules (source types, target types) and symmetric relations.
ENTITY_TYPES = ["person", "place", "organization", "item", "skill", "concept"]
_ANY = ENTITY_TYPES
_ACTOR = ["person", "organization"]
_WHOLE = ["place", "organization", "item"]
RELATIONS: dict[str, tuple[list[str], list[str]]] = {
    "disciple_of": (["person"], ["person"]),
    "parent_of": (["person"], ["person"]),
    "sibling_of": (["person"], ["person"]),
    "spouse_of": (["person"], ["person"]),
    "friend_of": (["person"], ["person"]),
    "knows": (["person"], ["person"]),
    "cooperates_with": (_ACTOR, _ACTOR),
    "hostile_to": (_ACTOR, _ACTOR),
    "member_of": (["person"], ["organization"]),
    "subordinate_to": (_ACTOR, _ACTOR),
    "located_in": (_ANY, ["place"]),
    "possesses": (_ACTOR, ["item"]),
    "uses": (_ACTOR, ["item", "skill"]),
    "part_of": (_WHOLE, _WHOLE),
}
SYMMETRIC = ["sibling_of", "spouse_of", "friend_of", "knows", "cooperates_with", "hostile_to"]
SAME_TYPE = ["subordinate_to", "part_of"]
POLARITIES = ["affirmed", "denied"]
MODES = ["narration", "character_claim"]
GENERIC_NAMES = ["他", "她", "它", "师父", "师傅", "陛下", "先生", "少年", "少女", "老人", "男子", "女子"]

# every permitted (relation, source type, target type); its size is fixed by the table above
ALLOWED = [f"{kind}|{a}|{b}" for kind, (left, right) in RELATIONS.items() for a in left for b in right
           if kind not in SAME_TYPE or a == b]


def allowed(kind: Column, source_type: Column, target_type: Column) -> Column:
    """Endpoint check as a set membership; unknown kinds and missing endpoints are not allowed."""
    return F.coalesce(F.concat_ws("|", kind, F.coalesce(source_type, F.lit("?")), F.coalesce(target_type, F.lit("?"))).isin(ALLOWED), F.lit(False))


def is_generic(name: Column) -> Column:
    return name.isin(GENERIC_NAMES)


def is_symmetric(kind: Column) -> Column:
    return kind.isin(SYMMETRIC)
