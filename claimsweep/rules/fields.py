"""Rule pack for labelled field extraction and candidate validation."""

# ---- fixed values (must equal the audited system's for equal results) ----

#: field -> patterns tried in order; group 1 is the value
FIELD_PATTERNS = {
    "invoice_amount": (
        r"(?:发票金额|价税合计|住宿金额)[^0-9\n]{0,16}?[¥￥]?\s*(\d+(?:\.\d{1,2})?)",
        r"(?:发票金额|价税合计|住宿金额)[^0-9]{0,16}?[（(]?小写[）)]?\s*[¥￥]?\s*(\d+(?:\.\d{1,2})?)",
    ),
    "payment_amount": (
        r"(?:付款金额|支付金额|实付金额)[^0-9\n]{0,16}?[¥￥]?\s*(\d+(?:\.\d{1,2})?)",
        r"(?:付款金额|支付金额|实付金额)[^0-9]{0,16}?[（(]?小写[）)]?\s*[¥￥]?\s*(\d+(?:\.\d{1,2})?)",
    ),
    "invoice_date": (r"(?:发票日期|开票日期)\s*[:：]?\s*(\d{4}[-/.年]\d{1,2}[-/.月]\d{1,2}日?)",),
    "travel_start_date": (r"(?:出差开始|出差起始日期)\s*[:：]?\s*(\d{4}[-/.年]\d{1,2}[-/.月]\d{1,2}日?)",),
    "travel_end_date": (r"(?:出差结束|出差结束日期)\s*[:：]?\s*(\d{4}[-/.年]\d{1,2}[-/.月]\d{1,2}日?)",),
    "travel_city": (r"(?:出差城市|目的地)\s*[:：]?\s*([\u4e00-\u9fff]{2,8})",),
    "invoice_number": (r"(?:发票号码|发票号)\s*[:：]?\s*([A-Za-z0-9-]{5,32})",),
    "invoice_code": (r"(?:发票代码)\s*[:：]?\s*([A-Za-z0-9-]{5,32})",),
    "applicant_name": (r"(?:申请人|报销人)\s*[:：]?\s*([\u4e00-\u9fff]{2,5})",),
    "invoice_buyer": (
        r"(?:购买方|购方名称|发票抬头)\s*[:：]?\s*([\u4e00-\u9fffA-Za-z0-9（）()·\-]{2,32})",
        r"名\s*称\s*[:：]\s*((?:(?!纳税人识别号|地址|电话|开户行|税号|密码区)"
        r"[\u4e00-\u9fffA-Za-z0-9（）()·\-]){2,40})",
    ),
    "payment_party": (r"(?:收款方|收款人|收款单位|收款账户名)\s*[:：]?\s*([\u4e00-\u9fffA-Za-z0-9（）()·\-]{2,32})",),
}

#: field -> for each of its patterns the words one of which every match starts with; a pattern without such words
#: is tried on every page
FIELD_STARTS = {
    "invoice_amount": (("发票金额", "价税合计", "住宿金额"), ("发票金额", "价税合计", "住宿金额")),
    "payment_amount": (("付款金额", "支付金额", "实付金额"), ("付款金额", "支付金额", "实付金额")),
    "invoice_date": (("发票日期", "开票日期"),),
    "travel_start_date": (("出差开始", "出差起始日期"),),
    "travel_end_date": (("出差结束", "出差结束日期"),),
    "travel_city": (("出差城市", "目的地"),),
    "invoice_number": (("发票号码", "发票号"),),
    "invoice_code": (("发票代码",),),
    "applicant_name": (("申请人", "报销人"),),
    "invoice_buyer": (("购买方", "购方名称", "发票抬头"), ()),
    "payment_party": (("收款方", "收款人", "收款单位", "收款账户名"),),
}

#: labels that mark a signature row, and the payee values that are only labels
SIGNATURE_LABELS = ("收款人", "复核", "开票人", "审核人", "签章")
REJECTED_VALUES = {"payment_party": ("复核", "开票人", "收款人", "收款方", "审核", "审核人", "签章")}

#: fields a model may propose (no invoice_code)
CANDIDATE_FIELDS = (
    "invoice_amount", "payment_amount", "invoice_date", "travel_start_date", "travel_end_date",
    "travel_city", "invoice_number", "applicant_name", "invoice_buyer", "payment_party",
)
MIN_CONFIDENCE = 0.7

#: full-match formats of proposed values
CANDIDATE_FORMATS = {
    "travel_city": (r"[\u4e00-\u9fff]{2,8}市?", "invalid city format"),
    "invoice_number": (r"[A-Za-z0-9-]{5,32}", "invalid invoice number format"),
    "applicant_name": (r"[\u4e00-\u9fff]{2,5}", "invalid applicant name format"),
    "invoice_buyer": (r"[\u4e00-\u9fffA-Za-z0-9（）()·\-]{2,32}", "invalid invoice_buyer format"),
    "payment_party": (r"[\u4e00-\u9fffA-Za-z0-9（）()·\-]{2,32}", "invalid payment_party format"),
}

#: response field -> path below the container, and the container's path
API_FIELD_MAP = {
    "invoice_code": "InvoiceCode",
    "invoice_number": "InvoiceNum",
    "invoice_date": "InvoiceDate",
    "invoice_amount": "AmountInFiguers",
    "invoice_buyer": "PurchaserName",
}
API_FIELDS_PATH = "words_result"
API_WRAPPER_KEYS = ("value", "text", "word", "content")
FIELD_TEXT_LABELS = {
    "invoice_code": "发票代码",
    "invoice_number": "发票号码",
    "invoice_date": "开票日期",
    "invoice_amount": "发票金额",
    "payment_amount": "付款金额",
    "invoice_buyer": "购买方",
    "payment_party": "付款方",
    "travel_city": "出差城市",
    "travel_start_date": "出差开始",
    "travel_end_date": "出差结束",
    "applicant_name": "申请人",
}
