"""Rule pack for material files: typing, text quality, injection and readability."""

# ---- fixed values (must equal the audited system's for equal results) ----

MAX_FILE_BYTES = 8 * 1024 * 1024
FILE_KINDS = {
    ".pdf": "pdf_text", ".png": "image_ocr", ".jpg": "image_ocr", ".jpeg": "image_ocr",
    ".txt": "text", ".docx": "docx", ".xlsx": "xlsx",
}
OCR_PREFIXES = ("image_ocr", "pdf_ocr")
LOW_DENSITY_CHARS = 20

MATERIAL_LABELS = {"invoice": "发票", "payment": "付款凭证", "approval": "审批单"}
CONTENT_SIGNALS = {
    "invoice": ("发票代码", "发票号码", "价税合计", "增值税", "开票日期", "校验码", "发票专用章"),
    "payment": ("付款金额", "支付金额", "付款时间", "支付时间", "付款凭证", "流水号", "交易流水", "转账"),
    "approval": ("审批意见", "审批人", "审批单", "审批通过", "出差审批", "报销申请", "申请单", "同意"),
}
STRUCTURED_SIGNALS = {
    "invoice": ("invoice_code", "invoice_number", "invoice_date", "invoice_amount", "invoice_buyer"),
    "payment": ("payment_amount", "payment_party"),
    "approval": (),
}
FILENAME_HINTS = {
    "invoice": ("invoice", "发票"),
    "payment": ("payment", "付款", "支付", "流水"),
    "approval": ("approval", "审批", "申请单"),
}
MIN_CONTENT_SIGNALS = 2

HANDWRITING_KEYWORDS = ("签字", "签名", "手写", "盖章", "印章", "按手印", "签署")
MEANINGFUL_CHARS = r"""[\u4e00-\u9fffA-Za-z0-9\s，。：；、（）()%¥￥\-—.,:;/\\'"*#&+]"""
MIN_REGION_CHARS = 10
MAX_GARBLED_RATIO = 0.3
QUALITY_KEYWORDS = ("发票", "金额", "日期", "付款", "申请人", "城市", "号码", "购买方", "收款方", "出差")

INJECTION_RULES = (
    ("忽略指令", r"忽略\s*(?:以上|上述|之前|前面|所有|全部)[^\n]{0,12}(?:规则|指令|要求|说明)"),
    ("忽略指令", r"ignore\s+(?:all\s+)?(?:previous|above|prior)\s+instructions?"),
    ("系统指令伪造", r"(?:系统|管理员|平台)\s*(?:指令|提示|要求)[^\n]{0,10}[:：]"),
    ("系统指令伪造", r"(?:system\s*prompt|override\s+(?:the\s+)?rules?)"),
    ("要求直接判合规", r"(?:直接|请|应当|必须)\s*(?:判定|输出|给出|返回)[^\n]{0,6}(?:合规|通过|pass)"),
    ("要求跳过检查", r"(?:跳过|无需|不用|不要)[^\n]{0,6}(?:检查|审核|核对)"),
    ("角色扮演", r"(?:你现在是|从现在开始你是|扮演)[^\n]{0,12}(?:角色|助手|审核员)"),
    ("越权特批", r"(?:已|已经)?(?:由)?[^\n]{0,8}(?:总监|总经理|老板|CEO)[^\n]{0,6}(?:特批|批准)[^\n]{0,8}(?:无需|不用|不必)"),
)
#: for each rule the word groups of which every match holds one word each, in lower case
INJECTION_WORDS = (
    (("忽略",), ("以上", "上述", "之前", "前面", "所有", "全部"), ("规则", "指令", "要求", "说明")),
    (("ignore",), ("previous", "above", "prior"), ("instruction",)),
    (("系统", "管理员", "平台"), ("指令", "提示", "要求"), (":", "：")),
    (("system", "override"),),
    (("直接", "请", "应当", "必须"), ("判定", "输出", "给出", "返回"), ("合规", "通过", "pass")),
    (("跳过", "无需", "不用", "不要"), ("检查", "审核", "核对")),
    (("你现在是", "从现在开始你是", "扮演"), ("角色", "助手", "审核员")),
    (("总监", "总经理", "老板", "ceo"), ("特批", "批准"), ("无需", "不用", "不必")),
)
MAX_INJECTION_SNIPPETS = 3

SYNTHETIC_MARKERS = ("【OCR-MOCK】", "【OCR-STUB】")
MIN_READABLE_CHARS = 12

HTML_ENTITIES = (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&nbsp;", " "), ("&amp;", "&"))

EXPENSE_KEYWORDS = {
    "MEDICAL": ("医药", "药", "pharm", "medical", "处方"),
    "PURCHASE": ("采购", "办公", "office", "purchase", "设备"),
}
DEFAULT_EXPENSE_TYPE = "TRAVEL"
