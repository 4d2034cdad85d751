"""Candidate profiles as weighted text and as a skill set."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from shortlist.functions.text import collapse


def _strings() -> Column:
    return F.array().cast("array<string>")


def _list(col: Column | str) -> Column:
    return F.coalesce(F.col(col) if isinstance(col, str) else col, _strings())


def _text(col: Column | str) -> Column:
    return F.coalesce(F.col(col) if isinstance(col, str) else col, F.lit(""))


def _lists(col: str) -> Column:
    """Value lists of an open-keyed object, in the order of its keys."""
    values = F.map_values(col)
    return F.coalesce(F.filter(values, lambda v: v.isNotNull()),
                      F.array().cast("array<array<string>>"))


def _each(col: str | Column, parts) -> Column:
    """Flattened parts of every element of an array of structs."""
    col = F.col(col) if isinstance(col, str) else col
    return F.coalesce(F.flatten(F.transform(col, parts)), _strings())


def profile_text(profiles: DataFrame, out: str = "profile_text", roles: int | None = None) -> DataFrame:
    """Weighted text of each profile; skills and keywords appear twice. `roles` keeps only the first ones."""
    experience = F.col("experience") if roles is None else F.slice("experience", 1, roles)
    skill_lines = F.transform(_lists("technical_skills"), lambda v: F.array_join(v, " "))
    domains = _lists("domain_expertise")

    def role_parts(role: Column) -> Column:
        achievements = F.flatten(F.transform(
            F.coalesce(role["achievements"], F.array().cast("array<struct<description:string,impact:string>>")),
            lambda a: F.array(a["description"], a["impact"])))
        headline = F.concat(_text(role["role"]), F.lit(" at "), _text(role["company"]))
        return F.concat(F.array(headline, role["summary"]), achievements, _list(role["tech_used"]))

    parts = F.concat(
        F.array("summary.headline", "summary.elevator_pitch"),
        _list("tone_and_style.things_to_emphasize"),
        F.flatten(F.transform(skill_lines, lambda line: F.array(line, line))),
        F.flatten(domains),
        _list(F.try_element_at("domain_expertise", F.lit("bioinformatics_focus"))),
        _each(experience, role_parts),
        _each("certifications", lambda c: F.array(c["name"])),
        _each("projects", lambda p: F.concat(
            F.array(p["name"], p["description"]), _list(p["tech_used"]))),
        _list("ats_keywords_pool"), _list("ats_keywords_pool"),
        _list("open_roles_targeted.primary"), _list("open_roles_targeted.secondary"),
        _each("education", lambda e: F.array(F.concat_ws(
            " ", _text(e["degree"]), _text(e["field"]), _text(e["institution"])))),
    )
    filled = F.filter(parts, lambda p: p.isNotNull() & (p != ""))
    return profiles.withColumn(out, collapse(F.array_join(filled, " ")))


def profile_skills(profiles: DataFrame, out: str = "profile_skills") -> DataFrame:
    """Distinct lower-case skills, tools used in all roles and keywords, sorted."""
    every = F.concat(
        F.flatten(_lists("technical_skills")),
        _each("experience", lambda role: _list(role["tech_used"])),
        _list("ats_keywords_pool"))
    lowered = F.transform(F.filter(every, lambda s: s.isNotNull()), F.lower)
    return profiles.withColumn(out, F.array_sort(F.array_distinct(lowered)))
