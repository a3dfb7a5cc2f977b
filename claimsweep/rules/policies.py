"""Rule pack for policy clauses: baseline texts, metadata prefixes, city lists, chunking patterns."""

# ---- fixed values (must equal the audited system's for equal results) ----

#: baseline policy rows in file order: (source_file, chunk_id, section, content)
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
    ("expense_policy.json", "EXP-V1-4.4", "4.4",
     "员工因私事(如探亲、旅游)出差的交通和住宿费用不予报销,需使用个人账户支付。"),
    ("expense_policy.json", "EXP-V1-4.5", "4.5",
     "差旅费发票抬头必须为申请人公司全称或申请人本人姓名,抬头不符不予报销。"),
    ("expense_policy.json", "EXP-V1-5.1", "5.1",
     "报销申请须在出差结束后30个自然日内提交,逾期需部门负责人书面说明。"),
    ("expense_policy.json", "PHARM-V1-3.2", "3.2",
     "医药费报销:门诊处方药实报实销,需附医院电子处方单;自费药(非医保目录)不予报销。"),
    ("expense_policy.json", "PHARM-V1-3.3", "3.3",
     "住院医疗费:医保报销后的个人自付部分按80%比例报销,单次上限3000元。"),
    ("expense_policy.json", "OFFICE-V2-2.1", "2.1",
     "办公用品采购单笔超过500元的须提供询价记录;单笔超过2000元的须经部门经理审批。"),
    ("expense_policy.json", "OFFICE-V2-2.3", "2.3",
     "设备采购(电脑、显示器等IT设备)由IT部门统一采购,个人不得自行购买后报销。"),
    ("travel_policy.json", "TRAVEL-V1-4.2-A", "4.2", "北京、上海、广州、深圳的住宿标准为600元/晚。"),
    ("travel_policy.json", "TRAVEL-V1-4.2-B", "4.2", "其他城市的住宿标准为450元/晚。"),
)

#: chunk id prefix -> (policy_id, expense_type)
PREFIX_META = {
    "TRAVEL": ("TRAVEL", "TRAVEL"),
    "EXP": ("EXPENSE", "EXPENSE"),
    "PHARM": ("MEDICAL", "MEDICAL"),
    "OFFICE": ("PURCHASE", "PURCHASE"),
}
DEPARTMENTS = ("市场部", "销售部", "研发部", "技术部")
BASELINE_EFFECTIVE_FROM = "2026-01-01"

FIRST_TIER_CITIES = ("北京", "上海", "广州", "深圳")
KNOWN_CITIES = FIRST_TIER_CITIES + (
    "杭州", "南京", "苏州", "成都", "武汉", "西安", "重庆", "天津", "长沙", "郑州", "青岛", "厦门",
)
FALLBACK_PHRASE = "其他城市"
LODGING_PHRASE = "的住宿标准"
LODGING_QUERY = "{city} 住宿标准 差旅 报销 酒店"
NIGHTLY_LIMIT = r"(\d+(?:\.\d+)?)元/晚"

#: clause score by how it matched
SCORE_CITY, SCORE_FALLBACK, SCORE_PUBLISHED_CITY, SCORE_PUBLISHED = 1.0, 0.8, 1.05, 0.9
CLAUSES_KEPT = 2
RERANK_POOL = 6

EXPENSE_GATES = {
    "MEDICAL": ("医药", "处方", "住院", "医保", "药"),
    "PURCHASE": ("采购", "办公", "设备", "询价"),
}

HEADING_PATTERN = (r"^\s*(?:第\s*[一二三四五六七八九十百零\d]+\s*[章节条款]|\d+(?:\.\d+)*[、.\s]"
                   r"|[一二三四五六七八九十]+、)\s*(\S.*)$")
CHAPTER_PATTERN = (r"^\s*(?:第\s*[一二三四五六七八九十百零\d]+\s*章|[一二三四五六七八九十]+、"
                   r"|\d+\s*[、.]?\s*(?![\d.]))")
HEADING_CHARS = 60
MIN_PIECE_CHARS = 12
DEFAULT_SECTION = "正文"
TABLE_ROW_SUFFIX = "表格行"

#: keyword score multipliers: same city, fallback clause, first-tier clause for another city
CITY_BOOST, FALLBACK_BOOST, FIRST_TIER_CUT = 1.15, 1.5, 0.4
