"""Clinical fields of notes in one pass over the text: ordered patterns, the first that matches gives snippet, value and place.

Column expressions only. Patterns are tried in the order of their list, whatever
their place in the text. The value is the second group of a pattern that has two,
the first of one that has one, else the whole match. Case is ignored; letters, digits
and word ends are those of Unicode. A null text gives nulls, as does a field that
isn't found.
"""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# Patterns and words of the notes handled, in order.
_DATE = r"([0-9]{4}[./-][0-9]{1,2}[./-][0-9]{1,2}\s*[0-9]{0,2}:?[0-9]{0,2})"
_DAY = r"([0-9]{1,2}月[0-9]{1,2}日\s*[0-9]{0,2}:?[0-9]{0,2})"
FIELDS = {
    "onset": [rf"(发病时间|起病时间)[:：]?\s*{_DATE}", rf"(发病时间|起病时间)[:：]?\s*{_DAY}", r"(发病|起病)[:：]?\s*([0-9]{1,2}\s*[:：]\s*[0-9]{1,2})"],
    "arrival": [rf"(到院时间|入院时间|首次到院时间)[:：]?\s*{_DATE}", rf"(到院时间|入院时间|首次到院时间)[:：]?\s*{_DAY}"],
    "sampling": [rf"(采样时间|采血时间|标本采集时间)[:：]?\s*{_DATE}", rf"(采样时间|采血时间|标本采集时间)[:：]?\s*{_DAY}"],
    "nihss": [r"(NIHSS)[:：]?\s*([0-9]{1,2})", r"(NIHSS评分)[:：]?\s*([0-9]{1,2})", r"(美国国立卫生研究院卒中量表)[:：]?\s*([0-9]{1,2})"],
    "age": [r"(年龄)[:：]?\s*([0-9]{1,3})\s*岁", r"([0-9]{1,3})\s*岁"],
    "sex": [r"(性别)[:：]?\s*(男|女)", r"\b(男|女)\b"],
    "meds": [r"(用药)[:：]?\s*([^\n]{0,80})", r"(口服药|静滴|静脉)[:：]?\s*([^\n]{0,80})", r"(阿司匹林|氯吡格雷|他汀|阿托伐他汀|瑞舒伐他汀|依达拉奉|丁苯酞|奥拉西坦|甘露醇|降压|胰岛素)[^\n]{0,80}"],
}
SAMPLE = [r"(住院号|病案号|就诊号|门诊号)[:：]?\s*([A-Za-z0-9\-]+)", r"(姓名)[:：]?\s*([^\s]{2,6})"]
FLAGS = {
    "htn": ["高血压", "HTN"],
    "dm": ["糖尿病", r"\bDM\b"],
    "thrombolysis": ["溶栓", "rt-PA", "阿替普酶", "替奈普酶", "TNK"],
    "thrombectomy": ["取栓", "血管内治疗"],
}
GROUPS = {"HS": "出血|ICH|HS", "ZS": "缺血|脑梗|梗死|IS|ZS"}  # a later one overrides


def _insensitive(pattern: str) -> str:
    return f"(?iU){pattern}"


def found(text: Column, patterns: Sequence[str]) -> Column:
    """Struct of snippet, value and place (from 1) of the first pattern in the list that matches; null if none does."""
    out = []
    for p in patterns:
        q = _insensitive(p)
        group = min(re.compile(p).groups, 2)
        match = F.struct(F.regexp_extract(text, q, 0).alias("snippet"), F.regexp_extract(text, q, group).alias("value"), F.regexp_instr(text, F.lit(q)).alias("place"))
        out.append(F.when(text.rlike(q), match))
    return F.coalesce(*out)


def flag(text: Column, words: Sequence[str]) -> Column:
    """1 if one of the patterns stands in the text, else 0."""
    return F.coalesce(text.rlike(_insensitive("|".join(words))), F.lit(False)).cast("int")


def last_group(text: Column, groups: Mapping[str, str]) -> Column:
    """Name of the last pattern in order that stands in the text; null if none does."""
    out = F.lit(None).cast("string")
    for name, p in groups.items():
        out = F.when(text.rlike(_insensitive(p)), name).otherwise(out)
    return out


def sample_id(text: Column, patterns: Sequence[str] = SAMPLE) -> Column:
    """Kind and value of the first pattern that matches, joined by _."""
    return F.coalesce(*(F.when(text.rlike(_insensitive(p)), F.concat_ws("_", F.regexp_extract(text, _insensitive(p), 1), F.regexp_extract(text, _insensitive(p), 2))) for p in patterns))


def extract(text: Column, fields: Mapping[str, Sequence[str]] = FIELDS, flags: Mapping[str, Sequence[str]] = FLAGS) -> dict[str, Column]:
    """Columns by name: of each field its struct, of each flag 0 or 1, and sample_id and patient_group.

    The value of ``meds`` is the snippet where the value is empty, 120 characters at most.
    """
    out = {name: found(text, patterns) for name, patterns in fields.items()}
    if "meds" in out:
        m = out["meds"]
        out["meds"] = F.when(m.isNotNull(), m.withField("value", F.substring(F.coalesce(F.nullif(m["value"], F.lit("")), m["snippet"]), 1, 120)))
    return out | {name: flag(text, words) for name, words in flags.items()} | {"sample_id": sample_id(text), "patient_group": last_group(text, GROUPS)}
