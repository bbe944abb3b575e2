"""Hosts of notices: candidates, their validity, joint hosts, and what stands in for none
(survey rows K12 to K20).

Each step is a column of its own, so that a candidate is made once and judged by later steps.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import contains_any
from ..plans.views import table
from ..registry import query
from ..sources.tables import once_each

# Fixed values from here on: word lists and patterns of the surveyed program, in its order.
NOT_IN_NAMES = (
    "通知", "活动", "比赛", "竞赛", "举办", "报名", "参赛", "时间", "内容", "要求", "作品", "指南", "选拔", "电话", "邮箱", "他们", "穿梭", "检录", "赛场", "同学们", "我院", "我校",
    "选手", "短信", "评审团", "收到", "底部", "大活中心", "提高", "展示", "入选", "每年", "同时", "旨在", "激发", "强化", "以二级", "大学生", "考生", "同学", "个人中心", "学院组委会",
    "有广泛影响力", "全国性大学", "国家级权威赛事", "正式文件落款日期为准", "教育行政主管部门", "研究会", "本届大赛", "选手将收到", "评审团由学院", "。", "！", "？",
)
NOT_FIRST = r"^(?:本次|全国|在|结合|为了|全体|该|学院|则|并|或|及|提高|展示|激发|入选|每年|同时|旨在|强化|以二级|第[一二三四五六七八九十0-9]+)"
NAME_ENDS = ("学院", "大学", "学校", "系", "部", "处", "中心", "部门", "组委会", "协会", "学会", "联合会", "委员会", "团委", "研究生会", "学生会")
GENERIC = ("工程系", "管理系", "会计系", "金融系", "经济系", "统计系")
ROLE = r"^(?:主办单位|承办单位|主办方|承办方|主办|承办|协办单位|协办方|协办|指导单位|组织单位|负责单位)[:：]?\s*"
NAME_IN = r"([^，。；;\s]{2,30}?(?:学院|大学|中心|组委会|协会|部门|处|委员会|团委|研究生会|学生会))"
SHORT_SCHOOL = r"([^，。；;\s]{2,8}学院)"
NAME_LAST = r"([^，。；;\s]{2,12}?(?:学院|大学|中心|组委会|协会|部门|处|委员会|团委|研究生会|学生会))\z"
ANNOUNCEMENTS = (r"关于组织[^，。；;\n]{0,60}(参加|开展|举办)", r"关于[^，。；;\n]{0,40}通知", r"文件由[^，。；;\n]{0,40}(主办|承办)", r"现将[^，。；;\n]{0,40}(通知如下|有关事项通知如下)")
UNIT = r"([\x{4e00}-\x{9fa5}A-Za-z]{2,30}(?:学院|大学|学校|系|部|处|中心|部门|组委会|协会|委员会|团委|研究生会|学生会))"
UNIT_ORDER = ("学院", "大学", "学校", "系", "部", "处", "委员会", "团委", "研究生会", "学生会", "组委会", "协会", "部门", "中心")
NO_UNIT = ("此次", "本次", "大赛", "通知", "比赛", "竞赛", "关于")
JOINT = (
    r"由\s*([^。；;\n]{4,120}?)\s*(?:共同)?主办", r"由\s*([^。；;\n]{4,120}?)\s*(?:共同)?举办", r"由\s*([^。；;\n]{4,200}?)\s*联合发起并主办",
    r"由\s*([^。；;\n]{4,200}?)\s*联合主办", r"([^。；;\n]{4,200}?)\s*联合发起并主办", r"([^。；;\n]{4,200}?)\s*联合主办",
)
NO_JOINT = ("共同", "主办", "举办", "全国性", "大学生", "竞赛", "活动", "各级", "各类", "（", "）", "(", ")")
JOINT_MARKS = ("中央", "教育部", "教育厅", "学联", "联合会", "科协", "科学技术协会", "共青团", "省委", "委员会", "团委", "学院", "大学", "学校", "部门", "处", "中心", "协会")
LABELS = (
    r"(?:主办单位|主办方|主办)[:：]?\s*([^。；;\n]{2,80})", r"(?:承办单位|承办方|承办)[:：]?\s*([^。；;\n]{2,80})", r"(?:组织单位|负责单位|协办单位|协办方|协办|指导单位)[:：]?\s*([^。；;\n]{2,80})",
)
LABEL_STOP = r"(?:[。；;\n]|(?:\s*[一二三四五六七八九十]+\s*、)|参与对象|参赛对象|竞赛对象|奖励对象|参赛资格|报名条件|奖项设置|联系方式|报名方式)"
LABEL_TAIL = r"，\s*(?:则|并|或|以及|且)|，\s*其中|，\s*并由"
FRAGMENTS = ("基于", "完善与", "展示了", "旨在", "激发", "提高", "每年", "同时也", "普通高等学校", "全日制在校", "以二级", "和众多", "入选", "挑战杯", "AI大学", "各类大学")
FUNCTION_WORDS = ("的", "和", "与", "在", "为")
KNOWN_SCHOOLS = ("清华", "北京", "武汉", "经济学院")
NO_HOSTS = ("中国大学", "中国国际大学", "团委、研究生会", "团委和研究生会", "研究生会、团委")
PART_MARKS = ("委", "厅", "部", "会", "院", "校", "中心", "协会", "联合会", "学联", "科协", "团")
#: Names that decide at once: (host, any of these, all of these).
ALIASES = (
    ("中国商业统计学会", ("中国商业统计学会", "中国商业统计"), ()),
    ("中国物流与采购联合会", ("中国物流与采购联合会", "物流与采购联合会", "clppx.org.cn"), ()),
    ("中国教育国际交流协会、中国高等教育学会", ("联合发起并主办", "联合主办"), ("中国教育国际交流协会", "中国高等教育学会")),
    ("中国电子视像行业协会", ("中国电子视像行业协会",), ()),
    ("教育部高校电子商务类专业教学指导委员会", ("教育部高校电子商务类专业教学指导委员会",), ()),
    ("教育部等12个中央部委和地方省级人民政府", ("教育部等12个中央部委和地方省级人民政府",), ()),
    ("会计学院研究生会", ("会计学院研究生会",), ()),
    ("教务处", ("教务处",), ("关于编制",)),
    ("中国人工智能学会、竞赛组委会", ("中国人工智能学会", "mit.caai.cn"), ("与竞赛组委会联合主办",)),
    ("中国人工智能学会、竞赛组委会", ("中国人工智能学会", "mit.caai.cn"), ("与竞赛组委会联合发起并主办",)),
    ("中国人工智能学会", ("中国人工智能学会", "mit.caai.cn"), ()),
    ("大学生就业指导中心", ("大学生就业指导中心", "就业指导中心"), ()),
    ("实验教学中心", ("实验教学中心", "实验教学"), ()),
)
# End of the fixed values.

TRIM = r"^\s+|[，。；;、\s]+\z"


def trimmed(v: Column) -> Column:
    """Without white space at either end and punctuation at the end."""
    return F.regexp_replace(v, TRIM, "")


def _found(v: Column, pattern: str, group: int = 1) -> Column:
    return F.nullif(F.regexp_extract(v, pattern, group), F.lit(""))


def _or(value: Column, other: Column) -> Column:
    return F.coalesce(value, other)


def valid(name: Column) -> Column:
    """Whether a candidate reads like the name of an organisation."""
    v = trimmed(name)
    parts = F.size(F.filter(F.split(v, r"[、,，和及与]"), lambda p: F.trim(p) != ""))
    length = (F.length(v) >= 2) & ((F.length(v) <= 30) | (v.contains("、") & (parts >= 2)))
    digits = F.length(v) - F.length(F.regexp_replace(v, "[0-9]", ""))
    return F.coalesce(length & ~contains_any(v, NOT_IN_NAMES) & ~v.rlike(NOT_FIRST) & (digits < 3) & contains_any(v, NAME_ENDS) & ~v.isin(*GENERIC), F.lit(False))


def _steps(v: Column, steps) -> Column:
    """Apply one function after the other to an element, each seeing its value once."""
    out = F.array(v)
    for s in steps:
        out = F.transform(out, s)
    return F.element_at(out, 1)


def core_name(name: Column) -> Column:
    """A candidate without roles, verbs and what follows the name: its last name by suffix."""
    last = lambda p: lambda v: _or(F.try_element_at(F.regexp_extract_all(v, F.lit(p), 1), F.lit(-1)), v)
    return _steps(name, [
        trimmed,
        lambda v: F.regexp_replace(v, ROLE, ""), lambda v: F.regexp_replace(v, r'^[的“"《\s]+', ""), lambda v: F.regexp_replace(v, r"^(?:是|由|在|于|及|和|与|并|年)+", ""),
        lambda v: F.trim(F.element_at(F.split(v, r"[。；;，]|\s{2,}|（|\("), 1)),
        lambda v: F.trim(F.regexp_replace(v, r"(?:主办|承办|协办|举办|组织|开展|发起|通知|校赛|选拔赛)\z", "")), lambda v: F.regexp_replace(v, r"^(?:由|是由|作为|针对|对于)\s*", ""),
        last(NAME_IN), last(SHORT_SCHOOL), lambda v: _or(_found(v, NAME_LAST), v), trimmed,
    ])


def cleaned(text: Column) -> Column:
    """White space is one space; the phrases of announcements go."""
    out = F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), r"\s+", " "))
    for p in ANNOUNCEMENTS:
        out = F.regexp_replace(out, p, "")
    return out


def core_unit(text: Column, own: str = "") -> Column:
    """The unit of a text with the best suffix, then the shortest, then the first by code points, whose
    core name is valid (K16). ``own``: the name of a home institution, a suffix before all others."""
    order = ([own] if own else []) + list(UNIT_ORDER)
    pattern = UNIT.replace("(?:", f"(?:{own}|", 1) if own else UNIT

    def scored(c):
        rank = F.lit(len(order))
        for i, s in reversed(list(enumerate(order))):
            rank = F.when(c.endswith(s), i).otherwise(rank)
        return F.struct(rank.alias("rank"), F.length(c).alias("length"), c.alias("name"))

    units = F.filter(F.array_distinct(F.regexp_extract_all(text, F.lit(pattern), 1)), lambda c: ~contains_any(c, NO_UNIT))
    names = F.transform(F.array_sort(F.transform(units, scored)), lambda s: core_name(s["name"]))
    return F.try_element_at(F.filter(names, valid), F.lit(1))


def joint_hosts(text: Column) -> Column:
    """Two and more hosts of a sentence that says that they host together, joined by 、; else null."""
    def of(pattern):
        parts = F.transform(F.split(F.trim(F.regexp_extract(text, pattern, 1)), "[、,，和及与]"), F.trim)
        good = F.filter(parts, lambda p: (p != "") & ~contains_any(p, NO_JOINT) & (F.length(p) <= 30))
        named = F.transform(good, lambda p: F.trim(F.regexp_replace(p, "^由", "")))
        units = F.array_distinct(F.filter(named, lambda p: contains_any(p, JOINT_MARKS)))
        return F.element_at(F.transform(F.array(units), lambda u: F.when(F.size(u) >= 2, F.array_join(u, "、"))), 1)

    return F.coalesce(*map(of, JOINT))


def sentence_fragment(name: Column) -> Column:
    """Whether a candidate is a piece of a sentence rather than a name."""
    v = F.trim(name)
    words = sum((F.when(v.contains(w), 1).otherwise(0) for w in FUNCTION_WORDS), F.lit(0))
    cut = v.endswith("大学") & (F.length(v) > 6) & ~contains_any(v, KNOWN_SCHOOLS)
    return F.coalesce((v == "") | contains_any(v, FRAGMENTS) | ((F.length(v) >= 12) & (words >= 2)) | cut | v.isin(*NO_HOSTS), F.lit(True))


def joint_candidate(name: Column) -> Column:
    """Whether a value lists two organisations and more."""
    v = trimmed(name)
    parts = F.filter(F.transform(F.split(v, "、"), F.trim), lambda p: (p != "") & F.length(p).between(2, 30) & contains_any(p, PART_MARKS))
    return F.coalesce(name.contains("、") & (F.length(v) <= 120) & (F.size(parts) >= 2), F.lit(False))


def with_organizer(notices: DataFrame, own: str = "", aliases=ALIASES) -> DataFrame:
    """Add ``parsed`` to ``notices`` (text): the host that the text names (K12). In order: an alias,
    joint hosts, a unit before "hosts", labelled hosts by role, any unit of the text; null if none."""
    t = F.col("_clean")
    step = notices.withColumn("_clean", cleaned(F.col("text")))
    named = [F.when(contains_any(t, some) & (F.lit(True) if not every else ~F.array_contains(F.array(*(t.contains(w) for w in every)), False)), host) for host, some, every in aliases]
    step = step.withColumn("_alias", F.coalesce(*named)).withColumn("_joint", F.when(F.col("_alias").isNull(), joint_hosts(t)))
    open_ = F.col("_alias").isNull() & F.col("_joint").isNull()
    unit = UNIT.replace("(?:", f"(?:{own}|", 1) if own else UNIT
    step = step.withColumn("_before", F.when(open_, core_name(F.regexp_extract(t, unit + r"\s*(?:主办|承办|协办)", 1))))
    for i, p in enumerate(LABELS):
        cut = F.element_at(F.split(F.trim(F.element_at(F.split(F.regexp_extract(t, p, 1), LABEL_STOP), 1)), LABEL_TAIL), 1)
        step = step.withColumn(f"_label{i}", F.when(open_, core_name(F.trim(cut)))).withColumn(f"_unit{i}", F.coalesce(core_unit(F.col(f"_label{i}"), own), F.col(f"_label{i}")))
    step = step.withColumn("_any", F.when(open_, core_unit(t, own)))
    good = lambda c: F.when(valid(F.col(c)), F.col(c))
    parsed = F.coalesce("_alias", "_joint", good("_before"), *(good(f"_unit{i}") for i in range(len(LABELS))), good("_any"))
    mine = ["_clean", "_alias", "_joint", "_before", "_any", *(f"_{n}{i}" for i in range(len(LABELS)) for n in ("label", "unit"))]
    return step.withColumn("parsed", parsed).drop(*mine)


def with_fallback(parsed: DataFrame, hosts: DataFrame, spiders: DataFrame) -> DataFrame:
    """Add ``organizer`` to ``parsed`` (url, spider, publisher, parsed): what the text names if it
    lists joint hosts, or is valid and no piece of a sentence; else the one of the url's host, of
    the spider, or a valid publisher, else null (K18 to K20). ``hosts`` and ``spiders``: (key, organizer), a
    key once; they are joined on equal keys, so they may be of any size.
    """
    p = F.col("parsed")
    keep = joint_candidate(p) | (valid(p) & ~sentence_fragment(p))
    host = F.lower(F.regexp_extract("url", r"^[a-zA-Z]+://([^/:?#]+)", 1))
    h, s = hosts.select(F.col("key").alias("_host"), F.col("organizer").alias("_of_host")), spiders.select(F.col("key").alias("_spider"), F.col("organizer").alias("_of_spider"))
    joined = parsed.join(h, host == F.col("_host"), "left").join(s, F.lower(F.trim("spider")) == F.col("_spider"), "left")
    publisher = F.when(valid(F.col("publisher")), F.trim("publisher"))
    return joined.withColumn("organizer", F.when(F.coalesce(keep, F.lit(False)), p).otherwise(F.coalesce("_of_host", "_of_spider", publisher))).drop("_host", "_of_host", "_spider", "_of_spider")


#: What notices say, by the number of their order's lines and its status: {A} a segment's school, {B} a
#: priority's association, {S} the plain segment.
SAID = {
    1: "由{A}、{B}和教育厅共同主办。", 2: "主办单位：{A}，则另行通知。", 3: "决赛由{S}组委会承办，{B}协办。", 4: "指导单位：{A}组委会，其中三人。参赛对象：学生",
    5: "{B}在年会上获奖，{S}大学表示祝贺。", 6: "{A}、{B}联合发起并主办的大赛", 7: "详见附件。",
}
SAID_BY_STATUS = {"F": "关于组织{A}参加年会。", "P": "现将{A}有关事项通知如下："}


def host_notices(spark, d) -> DataFrame:
    """Orders as notices (id, text, url, spider, publisher)."""
    lines = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.count(F.lit(1)).alias("n"))
    o = table(spark, d, "orders").join(lines, F.col("o_orderkey") == F.col("l_orderkey"), "left").join(table(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    priority = F.regexp_replace("o_orderpriority", "[^A-Z]", "")
    filled = lambda t: F.replace(F.replace(F.replace(t, F.lit("{A}"), F.concat("c_mktsegment", F.lit("学院"))), F.lit("{B}"), F.concat(priority, F.lit("协会"))), F.lit("{S}"), F.col("c_mktsegment"))
    pick = lambda c, words: F.coalesce(*(F.when(F.col(c) == k, w) for k, w in words.items()), F.lit(""))
    text = filled(F.concat(pick("o_orderstatus", SAID_BY_STATUS), pick("n", SAID)))
    url = F.concat(F.lit("https://"), F.lower("c_mktsegment"), F.lit(".example.org/n/"), F.col("o_orderkey"))
    return o.select(F.col("o_orderkey").alias("id"), text.alias("text"), url.alias("url"), F.lower(priority).alias("spider"), F.when(F.col("o_totalprice") > 250_000, F.concat("c_mktsegment", F.lit("处"))).otherwise(F.col("c_name")).alias("publisher"))


def known_hosts(spark, d) -> tuple[DataFrame, DataFrame]:
    """Of the segments' schools those whose names start before M, by host; of priorities all but one, by spider."""
    segments = table(spark, d, "customer").select("c_mktsegment").distinct().where("c_mktsegment < 'G'")
    priorities = table(spark, d, "orders").select(F.regexp_replace("o_orderpriority", "[^A-Z]", "").alias("p")).distinct().where("p <> 'LOW'")
    return segments.select(F.concat(F.lower("c_mktsegment"), F.lit(".example.org")).alias("key"), F.concat("c_mktsegment", F.lit("教务处")).alias("organizer")), priorities.select(F.lower("p").alias("key"), F.concat("p", F.lit("团委")).alias("organizer"))


def _sql() -> dict[str, str]:
    """The steps in SQL."""
    q = lambda p: "'" + p.replace("'", "''") + "'"
    any_of = lambda v, ws: "(" + " OR ".join(f"contains({v}, {q(w)})" for w in ws) + ")"
    sub = lambda v, p: f"regexp_replace({v}, {q(p)}, '', 'g')"
    get = lambda v, p: f"nullif(regexp_extract({v}, {q(p)}, 1), '')"
    cut = lambda v, p: f"string_split_regex({v}, {q(p)})[1]"
    trim_ = lambda v: sub(v, TRIM)
    chained = lambda v, steps: "list_transform(" * len(steps) + f"[{v}]" + "".join(f", lambda v: {s})" for s in steps) + "[1]"

    def ok(name):
        v = "v"
        test = f"length(v) >= 2 AND (length(v) <= 30 OR (contains(v, '、') AND len(list_filter(string_split_regex(v, '[、,，和及与]'), lambda p: trim(p) <> '')) >= 2)) AND NOT {any_of(v, NOT_IN_NAMES)} AND NOT regexp_matches(v, {q(NOT_FIRST)}) AND length(v) - length({sub(v, '[0-9]')}) < 3 AND {any_of(v, NAME_ENDS)} AND v NOT IN ({', '.join(map(q, GENERIC))})"
        return f"coalesce(list_transform([{trim_(name)}], lambda v: {test})[1], false)"

    last = lambda p: f"coalesce(regexp_extract_all(v, {q(p)}, 1)[-1], v)"
    core = lambda v: chained(v, [trim_("v"), sub("v", ROLE), sub("v", r'^[的“"《\s]+'), sub("v", r"^(?:是|由|在|于|及|和|与|并|年)+"), f"trim({cut('v', r'[。；;，]|\s{2,}|（|\(')})", f"trim({sub('v', r'(?:主办|承办|协办|举办|组织|开展|发起|通知|校赛|选拔赛)\z')})", sub("v", r"^(?:由|是由|作为|针对|对于)\s*"), last(NAME_IN), last(SHORT_SCHOOL), f"coalesce({get('v', NAME_LAST)}, v)", trim_("v")])
    rank = "CASE " + " ".join(f"WHEN ends_with(c, {q(s)}) THEN {i}" for i, s in enumerate(UNIT_ORDER)) + f" ELSE {len(UNIT_ORDER)} END"
    unit = lambda t: f"list_filter(list_transform(list_sort(list_transform(list_filter(list_distinct(regexp_extract_all({t}, {q(UNIT)}, 1)), lambda c: NOT {any_of('c', NO_UNIT)}), lambda c: {{'r': {rank}, 'l': length(c), 'n': c}})), lambda s: {core('s.n')}), lambda u: {ok('u')})[1]"

    def joint(p):
        parts = f"list_transform(string_split_regex(trim(regexp_extract(t, {q(p)}, 1)), '[、,，和及与]'), lambda p: trim(p))"
        named = f"list_transform(list_filter({parts}, lambda p: p <> '' AND NOT {any_of('p', NO_JOINT)} AND length(p) <= 30), lambda p: trim(regexp_replace(p, '^由', '')))"
        units = f"list_filter({named}, lambda p: {any_of('p', JOINT_MARKS)})"
        distinct = f"list_filter({units}, lambda p, i: list_position({units}, p) = i)"
        return f"CASE WHEN len(list_distinct({units})) >= 2 THEN array_to_string({distinct}, '、') END"

    clean = r"trim(regexp_replace(text, '\s+', ' ', 'g'))"
    for p in ANNOUNCEMENTS:
        clean = sub(clean, p)
    alias = " ".join(f"WHEN {any_of('t', some)}{''.join(f' AND contains(t, {q(w)})' for w in every)} THEN {q(host)}" for host, some, every in ALIASES)
    label = lambda p: core(f"trim({cut('trim(' + cut(f'regexp_extract(t, {q(p)}, 1)', LABEL_STOP) + ')', LABEL_TAIL)})")
    fragment = f"(n = '' OR {any_of('n', FRAGMENTS)} OR (length(n) >= 12 AND {' + '.join(f'CAST(contains(n, {q(w)}) AS INTEGER)' for w in FUNCTION_WORDS)} >= 2) OR (ends_with(n, '大学') AND length(n) > 6 AND NOT {any_of('n', KNOWN_SCHOOLS)}) OR n IN ({', '.join(map(q, NO_HOSTS))}))"
    listed = f"(contains(parsed, '、') AND length({trim_('parsed')}) <= 120 AND len(list_filter(list_transform(string_split({trim_('parsed')}, '、'), lambda p: trim(p)), lambda p: length(p) BETWEEN 2 AND 30 AND {any_of('p', PART_MARKS)})) >= 2)"
    case = lambda c, ws: "CASE " + " ".join(f"WHEN {c} = {k if isinstance(k, int) else q(k)} THEN {q(w)}" for k, w in ws.items()) + " ELSE '' END"
    base = f"""
WITH l AS (SELECT l_orderkey, count(*) AS n FROM lineitem GROUP BY 1),
o AS (SELECT *, regexp_replace(o_orderpriority, '[^A-Z]', '', 'g') AS p FROM orders LEFT JOIN l ON o_orderkey = l_orderkey JOIN customer ON o_custkey = c_custkey),
w AS (SELECT o_orderkey AS id, replace(replace(replace({case('o_orderstatus', SAID_BY_STATUS)} || {case('n', SAID)}, '{{A}}', c_mktsegment || '学院'), '{{B}}', p || '协会'), '{{S}}', c_mktsegment) AS text,
  lower(c_mktsegment) || '.example.org' AS host, lower(p) AS spider, CASE WHEN o_totalprice > 250000 THEN c_mktsegment || '处' ELSE c_name END AS publisher, c_mktsegment AS seg, p FROM o),
tidy AS (SELECT *, {clean} AS t FROM w)"""
    steps = f"""{base},
a AS (SELECT *, CASE {alias} END AS a, coalesce({', '.join(map(joint, JOINT))}) AS j, {core(f"regexp_extract(t, {q(UNIT + chr(92) + 's*(?:主办|承办|协办)')}, 1)")} AS b, {', '.join(f'{label(p)} AS l{i}' for i, p in enumerate(LABELS))} FROM tidy),
u AS (SELECT *, {', '.join(f"coalesce({unit(f'l{i}')}, l{i}) AS u{i}" for i in range(len(LABELS)))}, {unit('t')} AS x FROM a),
r AS (SELECT *, coalesce(a, j, CASE WHEN {ok('b')} THEN b END, {', '.join(f"CASE WHEN {ok(f'u{i}')} THEN u{i} END" for i in range(len(LABELS)))}, CASE WHEN {ok('x')} THEN x END) AS parsed FROM u)"""
    return {
        "joint": f"{base} SELECT id, coalesce({', '.join(map(joint, JOINT))}) AS hosts FROM tidy",
        "unit": f"{base} SELECT id, {unit('t')} AS unit FROM tidy",
        "parsed": f"{steps} SELECT id, parsed FROM r",
        "tests": f"{steps} SELECT id, coalesce({ok('parsed')}, false) AS valid, coalesce({fragment.replace('n,', 'trim(parsed),').replace('(n ', '(trim(parsed) ').replace('length(n)', 'length(trim(parsed))').replace(' n IN', ' trim(parsed) IN')}, true) AS fragment, coalesce({listed}, false) AS joint FROM r",
        "organizer": f"{steps}, k AS (SELECT *, trim(parsed) AS n FROM r) SELECT id, CASE WHEN coalesce({listed}, false) OR ({ok('parsed')} AND NOT coalesce({fragment}, true)) THEN parsed ELSE coalesce(CASE WHEN seg < 'G' THEN seg || '教务处' END, CASE WHEN p <> 'LOW' THEN p || '团委' END, CASE WHEN {ok('publisher')} THEN trim(publisher) END) END AS organizer FROM k",
    }


SQL = _sql()


@query("K17_joint_hosts", SQL["joint"])
def joint_hosts_query(spark, d):
    rows = host_notices(spark, d).select("id", "text")
    return once_each(rows, ["text"], lambda t: t.withColumn("hosts", joint_hosts(cleaned(F.col("text"))))).select("id", "hosts")


@query("K16_core_unit", SQL["unit"])
def core_unit_query(spark, d):
    rows = host_notices(spark, d).select("id", "text")
    units = lambda t: t.withColumn("t", cleaned(F.col("text"))).select("text", core_unit(F.col("t")).alias("unit"))
    return once_each(rows, ["text"], units).select("id", "unit")


@query("K12_organizer", SQL["parsed"])
def organizer_query(spark, d):
    """The host that each notice names, by all stages."""
    return once_each(host_notices(spark, d).select("id", "text"), ["text"], with_organizer).select("id", "parsed")


@query("K19_candidate_tests", SQL["tests"])
def candidate_tests(spark, d):
    """Validity, fragment and joint tests of what notices name."""
    p = F.col("parsed")
    tests = lambda t: with_organizer(t).select("text", valid(p).alias("valid"), sentence_fragment(p).alias("fragment"), joint_candidate(p).alias("joint"))
    return once_each(host_notices(spark, d).select("id", "text"), ["text"], tests).select("id", "valid", "fragment", "joint")


@query("K18_organizer_fallback", SQL["organizer"])
def organizer_fallback(spark, d):
    return with_fallback(once_each(host_notices(spark, d), ["text"], with_organizer), *known_hosts(spark, d)).select("id", "organizer")
