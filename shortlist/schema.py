"""Read schemas."""

from pyspark.sql import types as T

_strings = T.ArrayType(T.StringType())
_lists = T.MapType(T.StringType(), _strings)


def _struct(**fields: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(name, kind) for name, kind in fields.items()])


PROFILE = _struct(
    profile_id=T.LongType(),
    identity=_struct(full_name=T.StringType(), location=T.StringType()),
    summary=_struct(headline=T.StringType(), elevator_pitch=T.StringType()),
    tone_and_style=_struct(things_to_emphasize=_strings),
    technical_skills=_lists,
    domain_expertise=_lists,
    experience=T.ArrayType(_struct(
        role=T.StringType(), company=T.StringType(), summary=T.StringType(),
        achievements=T.ArrayType(_struct(description=T.StringType(), impact=T.StringType())),
        tech_used=_strings,
    )),
    certifications=T.ArrayType(_struct(name=T.StringType())),
    projects=T.ArrayType(_struct(
        name=T.StringType(), description=T.StringType(), tech_used=_strings)),
    ats_keywords_pool=_strings,
    open_roles_targeted=_struct(primary=_strings, secondary=_strings),
    education=T.ArrayType(_struct(
        degree=T.StringType(), field=T.StringType(), institution=T.StringType())),
    _meta=_struct(version=T.StringType()),
)

# One extracted posting, as an extraction response spells it.
EXTRACTED = _struct(
    is_relevant=T.StringType(), tech_stack=_strings, seniority=T.StringType(),
    employment_type=T.StringType(), min_years_exp=T.IntegerType(),
    salary_min=T.DoubleType(), salary_max=T.DoubleType(), reason=T.StringType(),
)
