"""Rule pack for claim titles."""

# ---- fixed values (must equal the audited system's for equal results) ----

EVENT_LABELS = {
    "HOTEL": "住宿报销",
    "ACCOMMODATION": "住宿报销",
    "TRAVEL": "差旅报销",
    "TRANSPORT": "交通报销",
    "TRAFFIC": "交通报销",
    "PURCHASE": "采购报销",
    "MEAL": "招待报销",
    "ENTERTAIN": "招待报销",
    "MEDICAL": "医药报销",
    "EXPENSE": "费用报销",
    "OFFICE": "办公采购报销",
}
EVENT_KEYWORDS = (
    ("住宿", "住宿报销"),
    ("酒店", "住宿报销"),
    ("差旅", "差旅报销"),
    ("交通", "交通报销"),
    ("车票", "交通报销"),
    ("机票", "交通报销"),
    ("采购", "采购报销"),
    ("办公", "采购报销"),
    ("招待", "招待报销"),
    ("餐", "招待报销"),
    ("医药", "医药报销"),
    ("医疗", "医药报销"),
)
MAX_TITLE_CHARS = 80
DATE_PATTERN = r"(\d{4})\D{0,2}(\d{1,2})\D{0,2}(\d{1,2})"
UNSAFE_FILE_CHARS = r'[\\/:*?"<>|\s]+'
DEFAULT_FILE_NAME = "claim-report"
