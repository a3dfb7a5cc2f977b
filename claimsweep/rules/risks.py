"""Rule pack for checks, risk grading and reports."""

# ---- fixed values (must equal the audited system's for equal results) ----

LEVELS = ("HIGH", "MEDIUM", "LOW", "INFO")
REVIEW_LEVELS = ("HIGH", "MEDIUM")
DEFAULT_LEVEL = "MEDIUM"
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

#: planned steps in order: tool -> fields it needs
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

NEXT_ACTIONS = {
    "REQUIRED_DOCUMENTS": "补充缺失材料后重新审核。",
    "AMOUNT_MATCH": "核对发票金额与付款凭证金额。",
    "DATE_RANGE": "核对发票日期和出差日期范围。",
    "HOTEL_LIMIT": "核对住宿标准、入住晚数和是否存在例外审批。",
    "APPLICANT_MATCH": "核对申请人、发票购买方和付款收款方是否为同一主体。",
    "MATERIAL_UNREADABLE": "配置真实 OCR 引擎（OCR_ENGINE=tesseract|http|mineru）或重新上传清晰材料后重跑。",
}
DEFAULT_NEXT_ACTION = "由财务审核员确认处理方式。"
