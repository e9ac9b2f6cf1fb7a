"""Rule tables of the meeting templates: registry, required and forbidden patterns, header fields, sections."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

MISSING = "（待確認）"
# The template registry (id, title, local only, needs source tags), in registry order.
TEMPLATES = [
    ("general", "會議紀錄", False, False),
    ("procurement_evaluation", "採購評選會議紀錄", True, False),
    ("section_meeting", "科務會議紀錄", False, True),
    ("isms_monthly", "ISMS月工作會議紀錄", False, False),
]
# Fixed values: (template, kind, label, pattern) in order.
RULES = [
    ("general", "required", "會議名稱", r"會議名稱\s*[:：]"),
    ("general", "required", "會議時間", r"會議時間\s*[:：]"),
    ("general", "required", "會議地點", r"會議地點\s*[:：]"),
    ("general", "required", "主席", r"主\s*席\s*[:：]"),
    ("general", "required", "出席人員", r"出席人員\s*[:：]"),
    ("general", "required", "列席人員", r"列席人員\s*[:：]"),
    ("general", "required", "記錄", r"記\s*錄\s*[:：]"),
    ("general", "required", "一、報告事項", r"一、\s*報告事項"),
    ("general", "required", "二、討論事項", r"二、\s*討論事項"),
    ("general", "required", "案由", r"案由\s*[:：]"),
    ("general", "required", "說明", r"說明\s*[:：]"),
    ("general", "required", "各單位意見", r"各單位意見"),
    ("general", "required", "決議", r"決議\s*[:：]"),
    ("general", "required", "三、主席裁示事項", r"三、\s*主席裁示事項"),
    ("general", "extra", "主辦單位", r"主辦單位\s*[:：]"),
    ("general", "extra", "辦理期程", r"辦理期程\s*[:：]"),
    ("procurement_evaluation", "required", "紀錄標題（採購評選委員會）", r"採購評選委員會"),
    ("procurement_evaluation", "required", "壹、會議時間", r"壹、\s*會議時間"),
    ("procurement_evaluation", "required", "伍、出席委員", r"伍、\s*出席委員"),
    ("procurement_evaluation", "required", "玖、投標廠商家數及名稱", r"玖、\s*投標廠商"),
    ("procurement_evaluation", "required", "拾參、廠商簡報及詢答事項", r"拾[參叁]、\s*廠商簡報"),
    ("procurement_evaluation", "required", "委員提問（詢答成對）", r"委員提問\s*[:：]"),
    ("procurement_evaluation", "required", "廠商答詢（詢答成對）", r"廠商答詢\s*[:：]"),
    ("procurement_evaluation", "required", "拾肆、委員討論及評選結果", r"拾肆、\s*委員討論及評選結果"),
    ("procurement_evaluation", "required", "拾陸、散會", r"拾陸、\s*散會"),
    ("procurement_evaluation", "forbidden", "底價相關數字（依採購法第34條不得寫入，須改為「（機敏資訊，不列入紀錄）」）", r"底價[^\n]{0,12}[\d０-９]"),
    ("procurement_evaluation", "forbidden", "個別委員評分數字（依最有利標評選辦法第20條不得寫入，須改為「（機敏資訊，不列入紀錄）」）", r"委員[^\n，。；]{0,6}(?:評分|給分|打分)[^\n]{0,8}[\d０-９]"),
    ("section_meeting", "required", "紀錄標題（科務會議）", r"科務會議紀錄"),
    ("section_meeting", "required", "時間", r"時間\s*[:：]"),
    ("section_meeting", "required", "主持人", r"主持人\s*[:：]"),
    ("section_meeting", "required", "決議事項彙整表（表頭）", r"案由及承辦單位"),
    ("section_meeting", "required", "科長指示及提醒事項", r"指示及提醒"),
    ("section_meeting", "required", "散會", r"散會\s*[:：]"),
    ("section_meeting", "forbidden", "彙整表內出現發言來源標註", r"(?m)^\|.*（[^）]{0,24}?\d{1,2}:\d{2}(?::\d{2})?[^）]{0,12}?）"),
    ("isms_monthly", "required", "專案名稱", r"專案名稱\s*[:：]"),
    ("isms_monthly", "required", "會議議題", r"會議議題\s*[:：]"),
    ("isms_monthly", "required", "參加人員", r"參加人員\s*[:：]"),
    ("isms_monthly", "required", "內容", r"內\s*容\s*[:：]"),
    ("isms_monthly", "required", "追蹤事項", r"追蹤事項\s*[:：]"),
    ("isms_monthly", "required", "決議事項", r"決議事項\s*[:：]"),
    ("isms_monthly", "required", "臨時動議", r"臨時動議\s*[:：]"),
]
# Header lines and sections of the general template.
GENERAL_HEADERS = [
    (f"會議名稱：{MISSING}", r"^會議名稱\s*[:：]"),
    (f"會議時間：{MISSING}", r"^會議時間\s*[:：]"),
    (f"會議地點：{MISSING}", r"^會議地點\s*[:：]"),
    (f"主  席：{MISSING}", r"^主\s*席\s*[:：]"),
    (f"出席人員：{MISSING}", r"^出席人員\s*[:：]"),
    ("列席人員：無", r"^列席人員\s*[:：]"),
    ("記  錄：AI 會議助理", r"^記\s*錄\s*[:：]"),
]
_FALLBACK = f"- {MISSING}（主辦單位：{MISSING}，辦理期程：{MISSING}）"
GENERAL_SECTIONS = [
    (r"一、\s*報告事項", ["一、 報告事項：", "無"], []),
    (
        r"二、\s*討論事項",
        ["二、 討論事項：", f"案由：{MISSING}", f"說明：{MISSING}", "各單位意見（多方立場）：", f"- {MISSING}：{MISSING}", "決議：", f"1. {MISSING}（主辦單位：{MISSING}，協辦單位：{MISSING}）"],
        [(r"案由\s*[:：]", [f"案由：{MISSING}"]), (r"說明\s*[:：]", [f"說明：{MISSING}"]), (r"各單位意見", ["各單位意見（多方立場）：", f"- {MISSING}：{MISSING}"]), (r"決議\s*[:：]", ["決議：", f"1. {MISSING}（主辦單位：{MISSING}，協辦單位：{MISSING}）"])],
    ),
    (r"三、\s*主席裁示事項", ["三、 主席裁示事項（後續管考與追蹤）：", _FALLBACK], [(r"辦理期程\s*[:：]", [_FALLBACK])]),
]

# Header lines and sections of the procurement template.
PROCUREMENT_HEADERS = [(f"「{MISSING}」案採購評選委員會第{MISSING}次會議（評選會議）紀錄", r"採購評選委員會第.*會議.*紀錄")]
PROCUREMENT_SECTIONS = [
    (r"壹、\s*會議時間", [f"壹、會議時間：{MISSING}"], []),
    (r"貳、\s*會議地點", [f"貳、會議地點：{MISSING}"], []),
    (r"[參叁]、\s*主持人", [f"參、主持人：{MISSING}（召集人）　記錄：AI 會議助理"], []),
    (r"肆、\s*評選委員會組成", [f"肆、評選委員會組成：{MISSING}"], []),
    (r"伍、\s*出席委員", [f"伍、出席委員：{MISSING}"], []),
    (r"陸、\s*請假委員", ["陸、請假委員：無"], []),
    (r"柒、\s*列席人員", ["柒、列席人員：無"], []),
    (r"捌、\s*評選方式", [f"捌、評選方式：{MISSING}"], []),
    (r"玖、\s*投標廠商", [f"玖、投標廠商家數及名稱：{MISSING}"], []),
    (r"拾、\s*主席致詞", ["拾、主席致詞：（略）"], []),
    (r"拾壹、\s*報告事項", ["拾壹、報告事項：無"], []),
    (r"拾貳、\s*委員確認事項", [f"拾貳、委員確認事項：{MISSING}"], []),
    (r"拾[參叁]、\s*廠商簡報", ["拾參、廠商簡報及詢答事項：", f"一、{MISSING}", f"（一）簡報要點：{MISSING}", "（二）詢答：", f"委員提問：{MISSING}", f"廠商答詢：{MISSING}"], []),
    (r"拾肆、\s*委員討論及評選結果", [f"拾肆、委員討論及評選結果：{MISSING}"], []),
    (r"拾伍、\s*委員是否有不同意見", ["拾伍、委員是否有不同意見：無"], []),
    (r"拾陸、\s*散會", [f"拾陸、散會：{MISSING}"], []),
]
# Header lines and sections of the section meeting's template.
SECTION_HEADERS = [
    (f"{MISSING}{MISSING}年{MISSING}月份第{MISSING}次科務會議紀錄", r"科務會議紀錄"),
    (f"時間：{MISSING}", r"^時間\s*[:：]"),
    (f"地點：{MISSING}", r"^地點\s*[:：]"),
    (f"主持人：{MISSING}　紀錄：AI 會議助理", r"^主持人\s*[:：]"),
    ("出席人員：如後附簽到表", r"^出席人員\s*[:：]"),
    (f"歷次科務會議決議事項繼續列管案件：{MISSING}", r"歷次.{0,14}列管案件"),
]
SECTION_SECTIONS = [
    (r"決議事項辦理情形彙整表|案由及承辦單位", [f"{MISSING}科務會議決議事項辦理情形彙整表", "決議事項：", "| 案由及承辦單位 | 辦理情形 | 解除列管 | 繼續列管 |", "| --- | --- | --- | --- |", f"| {MISSING} | {MISSING}： |  |  |"], []),
    (r"科長轉知", [f"一、科長轉知局務會議工作報告及相關注意事項：{MISSING}"], []),
    (r"指示及提醒", ["二、科長指示及提醒事項：", f"（一）{MISSING}"], []),
    (r"散會\s*[:：]", [f"散會：{MISSING}"], []),
]
# Header lines and sections of the ISMS template.
ISMS_HEADERS = [
    (f"機關名稱：{MISSING}", r"^機關名稱\s*[:：]"),
    (f"專案名稱：{MISSING}", r"^專案名稱\s*[:：]"),
    (f"會議議題：{MISSING}", r"^會議議題\s*[:：]"),
    (f"地點：{MISSING}", r"^地\s*點\s*[:：]"),
    (f"主席：{MISSING}", r"^(?:主\s*席|主持人)\s*[:：]"),
    (f"日期：{MISSING}", r"^日\s*期\s*[:：]"),
    (f"記錄：{MISSING}", r"^[記紀]\s*錄\s*[:：]"),
    (f"機關單位：{MISSING}", r"^機關單位\s*[:：]"),
    (f"廠商單位：{MISSING}", r"^廠商單位\s*[:：]"),
]
ISMS_SECTIONS = [
    (r"參加人員\s*[:：]", ["參加人員：", MISSING], []),
    (r"內\s*容\s*[:：]", ["內容：", f"一、{MISSING}"], []),
    (r"追蹤事項\s*[:：]", ["追蹤事項：", MISSING], []),
    (r"決議事項\s*[:：]", ["決議事項：", f"一、{MISSING}"], []),
    (r"臨時動議\s*[:：]", ["臨時動議：", MISSING], []),
]
#: Header lines and sections by template.
STRUCTURE = {"general": (GENERAL_HEADERS, GENERAL_SECTIONS), "procurement_evaluation": (PROCUREMENT_HEADERS, PROCUREMENT_SECTIONS), "section_meeting": (SECTION_HEADERS, SECTION_SECTIONS), "isms_monthly": (ISMS_HEADERS, ISMS_SECTIONS)}

# Form fields in order (field, label alternatives, whether the value stands on the label's line only).
FORM_FIELDS = [
    ("機關名稱", "機關名稱", True),
    ("專案名稱", "專案名稱", True),
    ("會議議題", "會議議題", False),
    ("地點", r"地\s*點", True),
    ("主席", r"主\s*席|主持人", True),
    ("日期", r"日\s*期", True),
    ("記錄", r"[記紀]\s*錄", True),
    ("機關單位", "機關單位", True),
    ("廠商單位", "廠商單位", True),
    ("參加人員", "參加人員", False),
    ("內容", r"內\s*容", False),
    ("追蹤事項", "追蹤事項", False),
    ("決議事項", "決議事項", False),
    ("臨時動議", "臨時動議", False),
]


def templates(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(i, *t) for i, t in enumerate(TEMPLATES)], "ord int, template_id string, title string, local_only boolean, traceability boolean")


def rules(spark: SparkSession, rows: list[tuple[str, str, str, str]] | None = None) -> DataFrame:
    """(template_id, kind, ord, label, pattern)."""
    return spark.createDataFrame([(t, k, i, n, p) for i, (t, k, n, p) in enumerate(RULES if rows is None else rows)], "template_id string, kind string, ord int, label string, pattern string")
