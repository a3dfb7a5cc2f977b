"""Fixed values of the rules and the fixture, written out here: the oracles share no constant with the package."""

# ---- fixed values ----
LEVELS = ("HIGH", "MEDIUM", "LOW", "INFO")
SEVERITY = {
    "REQUIRED_DOCUMENTS": "MEDIUM",
    "LOW_CONFIDENCE_FIELD": "MEDIUM",
    "MERCHANT_NAME_FORMAT": "LOW",
    "AMOUNT_MATCH": "HIGH",
    "DUPLICATE_INVOICE": "HIGH",
    "INVOICE_NUMBER_CONFLICT": "MEDIUM",
    "DATE_RANGE": "MEDIUM",
    "HOTEL_LIMIT": "MEDIUM",
    "RULE_MISSING": "MEDIUM",
    "APPLICANT_MATCH": "MEDIUM",
    "HANDWRITING_REVIEW": "MEDIUM",
    "OCR_QUALITY_REVIEW": "MEDIUM",
    "MATERIAL_QUALITY_INFO": "INFO",
    "MATERIAL_UNREADABLE": "HIGH",
    "AMOUNT_UNVERIFIABLE": "MEDIUM",
    "PROMPT_INJECTION": "HIGH",
}
LEVEL_ACTIONS = {"HIGH": "必须人工复核", "MEDIUM": "建议人工复核", "LOW": "提示并允许继续", "INFO": "仅展示"}
PLAN_STEPS = {
    "required_documents": (),
    "amount_match": ("invoice_amount", "payment_amount"),
    "date_range": ("invoice_date", "travel_start_date", "travel_end_date"),
    "hotel_limit": ("invoice_amount", "policy_evidence"),
    "applicant_match": ("applicant_name",),
    "check_duplicate_invoice": ("invoice_number",),
}
PLAN_REASONS = {
    "required_documents": "按报销类型核对必备材料清单",
    "amount_match": "确定性比对发票金额与付款金额",
    "date_range": "校验发票日期是否落在出差区间内",
    "hotel_limit": "依据制度条款校验住宿标准",
    "applicant_match": "跨文档对齐申请人/购买方/收款方",
    "check_duplicate_invoice": "查询历史记录,识别重复发票",
}
FIRST_TIER_CITIES = ("北京", "上海", "广州", "深圳")
EXPENSE_GATES = {"MEDICAL": ("医药", "处方", "住院", "医保", "药"), "PURCHASE": ("采购", "办公", "设备", "询价")}
CLAUSES_KEPT, RERANK_POOL = 2, 6
BASELINE_ROWS = (
    ("expense_policy.json", "EXP-V1-4.3-TABLE", "4.3",
     "表4-1 差旅费用标准表(元):\n"
     "| 费用类型 | 一线城市 | 二线城市 | 其他城市 | 适用部门 |\n"
     "| 住宿费/晚 | 600 | 500 | 450 | 市场部、销售部 |\n"
     "| 住宿费/晚 | 550 | 450 | 400 | 研发部、技术部 |\n"
     "| 交通费(市内)/天 | 100 | 80 | 60 | ALL |\n"
     "| 交通费(跨城)/次 | 800 | 800 | 800 | ALL |\n"
     "| 餐补/天 | 150 | 120 | 100 | ALL |\n"
     "| 异地租房补贴/月 | 2000 | 1800 | 1500 | 研发部 |\n"
     "| 商务会所宴请/人 | 300 | 300 | 300 | 市场部"),
    ("expense_policy.json", "EXP-V1-4.4", "4.4", "员工因私事(如探亲、旅游)出差的交通和住宿费用不予报销,需使用个人账户支付。"),
    ("expense_policy.json", "EXP-V1-4.5", "4.5", "差旅费发票抬头必须为申请人公司全称或申请人本人姓名,抬头不符不予报销。"),
    ("expense_policy.json", "EXP-V1-5.1", "5.1", "报销申请须在出差结束后30个自然日内提交,逾期需部门负责人书面说明。"),
    ("expense_policy.json", "PHARM-V1-3.2", "3.2", "医药费报销:门诊处方药实报实销,需附医院电子处方单;自费药(非医保目录)不予报销。"),
    ("expense_policy.json", "PHARM-V1-3.3", "3.3", "住院医疗费:医保报销后的个人自付部分按80%比例报销,单次上限3000元。"),
    ("expense_policy.json", "OFFICE-V2-2.1", "2.1", "办公用品采购单笔超过500元的须提供询价记录;单笔超过2000元的须经部门经理审批。"),
    ("expense_policy.json", "OFFICE-V2-2.3", "2.3", "设备采购(电脑、显示器等IT设备)由IT部门统一采购,个人不得自行购买后报销。"),
    ("travel_policy.json", "TRAVEL-V1-4.2-A", "4.2", "北京、上海、广州、深圳的住宿标准为600元/晚。"),
    ("travel_policy.json", "TRAVEL-V1-4.2-B", "4.2", "其他城市的住宿标准为450元/晚。"),
)

# ---- values of the fixture ----
DEPARTMENTS = ("市场部", "销售部", "研发部", "技术部", "ALL")
CITIES = ("北京", "上海", "广州", "深圳", "杭州", "成都", "武汉", "南京")
EXPENSE_TYPES = ("TRAVEL", "EXPENSE", "MEDICAL", "PURCHASE")
EVENT_STATES = {"signup": "CREATED", "view": "READY", "purchase": "COMPLETED", "error": "FAILED"}
