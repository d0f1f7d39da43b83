"""Small tables that the operators join or test against."""

from __future__ import annotations

# Section ids of item forms, by item number, in form order.
_ITEMS = {
    "10-K": """
        1 item_1_business; 1a item_1a_risk_factors; 1b item_1b_unresolved_staff_comments; 1c item_1c_cybersecurity; 2 item_2_properties;
        3 item_3_legal_proceedings; 4 item_4_mine_safety; 5 item_5_equity; 6 item_6_reserved; 7 item_7_mdna; 7a item_7a_market_risk;
        8 item_8_financial_statements; 9 item_9_disagreements; 9a item_9a_controls; 9b item_9b_other; 9c item_9c_foreign; 10 item_10_directors;
        11 item_11_compensation; 12 item_12_security_ownership; 13 item_13_related_transactions; 14 item_14_auditor_fees; 15 item_15_exhibits; 16 item_16_summary""",
    "10-Q": """
        1 item_1_financial_statements; 2 item_2_mdna; 3 item_3_market_risk; 4 item_4_controls; 1b part_ii_item_1_legal_proceedings;
        1a part_ii_item_1a_risk_factors; 2b part_ii_item_2_equity; 3b part_ii_item_3_defaults; 4b part_ii_item_4_mine_safety;
        5b part_ii_item_5_other; 6b part_ii_item_6_exhibits""",
    "20-F": """
        1 20f_item_1_directors_advisers; 2 20f_item_2_offer_statistics; 3 20f_item_3_key_information; 3.d 20f_item_3d_risk_factors;
        4 20f_item_4_company_information; 4.a 20f_item_4a_history; 4.b 20f_item_4b_business; 4.c 20f_item_4c_org_structure; 4.d 20f_item_4d_property;
        4a 20f_item_4a_unresolved_staff; 5 20f_item_5_operating_review; 5.a 20f_item_5a_operating_results; 5.b 20f_item_5b_liquidity;
        5.c 20f_item_5c_research; 5.d 20f_item_5d_trend; 5.e 20f_item_5e_off_balance; 5.f 20f_item_5f_contractual_obligations;
        6 20f_item_6_directors_employees; 6.a 20f_item_6a_directors; 6.b 20f_item_6b_compensation; 6.c 20f_item_6c_board_practices;
        6.d 20f_item_6d_employees; 6.e 20f_item_6e_share_ownership; 7 20f_item_7_shareholders; 7.a 20f_item_7a_major_shareholders;
        7.b 20f_item_7b_related_party; 7.c 20f_item_7c_experts; 8 20f_item_8_financial_info; 8.a 20f_item_8a_consolidated_statements;
        8.b 20f_item_8b_significant_changes; 9 20f_item_9_offer_listing; 9.a 20f_item_9a_listing_details; 10 20f_item_10_additional_info;
        10.b 20f_item_10b_articles; 10.e 20f_item_10e_taxation; 11 20f_item_11_market_risk; 12 20f_item_12_securities; 12.d 20f_item_12d_ads;
        13 20f_item_13_defaults; 14 20f_item_14_modifications; 15 20f_item_15_controls; 16a 20f_item_16a_audit_expert; 16b 20f_item_16b_code_ethics;
        16c 20f_item_16c_accountant_fees; 16d 20f_item_16d_listing_exemptions; 16e 20f_item_16e_equity_purchases; 16f 20f_item_16f_accountant_change;
        16g 20f_item_16g_governance; 16h 20f_item_16h_mine_safety; 16i 20f_item_16i_foreign_jurisdictions; 16j 20f_item_16j_insider_trading;
        16k 20f_item_16k_cybersecurity; 17 20f_item_17_financial_statements; 18 20f_item_18_financial_statements_alt; 19 20f_item_19_exhibits""",
    "8-K": """
        1.01 item_1_01_material_agreements; 1.02 item_1_02_termination_agreements; 1.03 item_1_03_bankruptcy; 1.04 item_1_04_mine_safety;
        1.05 item_1_05_material_cybersecurity; 2.01 item_2_01_acquisition; 2.02 item_2_02_results_of_operations; 2.03 item_2_03_direct_obligations;
        2.04 item_2_04_triggering_events; 2.05 item_2_05_departures; 2.06 item_2_06_material_impairment; 3.01 item_3_01_delisting;
        3.02 item_3_02_unregistered_sales; 3.03 item_3_03_material_modification; 4.01 item_4_01_changes_registrant_cpa; 4.02 item_4_02_non_reliance;
        5.01 item_5_01_changes_control; 5.02 item_5_02_officer_changes; 5.03 item_5_03_amendments; 5.04 item_5_04_temporary_suspension;
        5.05 item_5_05_amendment_code_ethics; 5.07 item_5_07_submission_vote; 5.08 item_5_08_shareholder_director; 6.01 item_6_01_aba;
        7.01 item_7_01_reg_fd; 8.01 item_8_01_other; 9.01 item_9_01_financial_statements""",
}

# Title expressions of forms without item numbers, in form order.
TITLES = {
    "S-1": [
        ("s1_prospectus_summary", r"PROSPECTUS SUMMARY"), ("s1_the_offering", r"THE OFFERING"), ("s1_risk_factors", r"RISK FACTORS"),
        ("s1_forward_looking", r"SPECIAL NOTE.{0,30}FORWARD.{0,30}LOOKING"), ("s1_use_of_proceeds", r"USE OF PROCEEDS"), ("s1_dividend_policy", r"DIVIDEND POLICY"),
        ("s1_capitalization", r"CAPITALIZATION"), ("s1_dilution", r"DILUTION"), ("s1_selected_data", r"SELECTED (?:FINANCIAL|CONSOLIDATED) DATA"),
        ("s1_summary_financial_data", r"SUMMARY (?:CONSOLIDATED |COMBINED )?FINANCIAL(?: AND OTHER)? DATA"), ("s1_mdna", r"MANAGEMENT.{0,10}S?\s+DISCUSSION AND ANALYSIS"),
        ("s1_business", r"BUSINESS"), ("s1_management", r"MANAGEMENT"), ("s1_executive_compensation", r"EXECUTIVE COMPENSATION"),
        ("s1_stockholders", r"PRINCIPAL (?:AND SELLING )?STOCKHOLDERS"), ("s1_related_transactions", r"CERTAIN RELATIONSHIPS"),
        ("s1_capital_stock", r"DESCRIPTION OF (?:OUR )?CAPITAL STOCK"), ("s1_future_sales", r"SHARES ELIGIBLE FOR FUTURE SALE"),
        ("s1_tax", r"MATERIAL U\.?S\.? FEDERAL INCOME TAX"), ("s1_underwriting", r"UNDERWRITING"), ("s1_plan_of_distribution", r"PLAN OF DISTRIBUTION"),
        ("s1_legal_matters", r"LEGAL MATTERS"), ("s1_experts", r"EXPERTS"), ("s1_financial_statements", r"FINANCIAL STATEMENTS"),
    ],
    "6-K": [
        ("6k_ceo_review", r"CHIEF EXECUTIVE.{0,30}(?:REVIEW|STATEMENT|REPORT)"), ("6k_financial_highlights", r"FINANCIAL HIGHLIGHTS"),
        ("6k_mdna", r"MANAGEMENT.{0,10}S?\s+DISCUSSION AND ANALYSIS"), ("6k_results", r"RESULTS OF OPERATIONS|OPERATING (?:AND FINANCIAL )?RESULTS|FINANCIAL REVIEW"),
        ("6k_trading_update", r"TRADING UPDATE"), ("6k_business_review", r"(?:BUSINESS|OPERATING) REVIEW"), ("6k_segments", r"SEGMENT(?:AL)? (?:RESULTS|PERFORMANCE|REVIEW)"),
        ("6k_liquidity", r"LIQUIDITY|CAPITAL RESOURCES"), ("6k_outlook", r"OUTLOOK|GUIDANCE|PROSPECTS"), ("6k_recent_developments", r"RECENT DEVELOPMENTS"),
        ("6k_dividend", r"DIVIDENDS?|CAPITAL RETURN"), ("6k_risk_factors", r"RISK FACTORS"), ("6k_interim_financials", r"INTERIM[^\n]{0,30}FINANCIAL STATEMENTS"),
    ],
    "DEF 14A": [
        ("proxy_notice", r"NOTICE OF ANNUAL"), ("proxy_summary", r"PROXY SUMMARY"), ("proxy_prop1_election", r"PROPOSAL\s+1[.:]?\s+ELECTION"),
        ("proxy_prop2_auditors", r"PROPOSAL\s+2[.:]?\s+RATIF"), ("proxy_prop3_say_on_pay", r"PROPOSAL\s+3[.:]?\s+(?:ADVISORY|SAY.ON.PAY)"),
        ("proxy_prop4", r"PROPOSAL\s+(?:NO\.\s*)?4\b\s*[.:—–-]?\s*(?:TO|APPROV|RATIF|AMEND|ADVISORY|ADOPT|ELECT|AUTHORIZ|INCREAS)"),
        ("proxy_prop5", r"PROPOSAL\s+(?:NO\.\s*)?5\b\s*[.:—–-]?\s*(?:TO|APPROV|RATIF|AMEND|ADVISORY|ADOPT|ELECT|AUTHORIZ|INCREAS)"),
        ("proxy_board", r"BOARD OF DIRECTORS"), ("proxy_governance", r"CORPORATE GOVERNANCE"), ("proxy_audit_committee", r"AUDIT COMMITTEE"),
        ("proxy_exec_compensation", r"EXECUTIVE COMPENSATION"), ("proxy_comp_committee", r"COMPENSATION COMMITTEE"), ("proxy_cd_a", r"COMPENSATION DISCUSSION"),
        ("proxy_summary_comp_table", r"SUMMARY COMPENSATION TABLE"), ("proxy_pay_vs_performance", r"PAY[ -]VERSUS[ -]PERFORMANCE"), ("proxy_pay_ratio", r"(?:CEO )?PAY RATIO"),
        ("proxy_director_comp", r"DIRECTOR COMPENSATION"), ("proxy_security_ownership", r"SECURITY OWNERSHIP"),
        ("proxy_equity_plan_info", r"EQUITY COMPENSATION PLAN INFORMATION"), ("proxy_related_transactions", r"CERTAIN RELATIONSHIPS"),
        ("proxy_delinquent_16", r"DELINQUENT SECTION 16"), ("proxy_additional_info", r"ADDITIONAL INFORMATION"), ("proxy_stockholder_proposals", r"STOCKHOLDER PROPOSAL"),
    ],
}

# Section id prefixes by priority.
PRIORITY = (
    "item_7_mdna part_ii_item_7 item_2_mdna item_1a_risk part_i_item_1a part_ii_item_1a item_8 item_1_business part_i_item_1 "
    "20f_item_5 20f_item_3d_risk_factors 20f_item_3_key_information 20f_item_8 20f_item_4b_business 20f_item_4_company_information "
    "s1_mdna s1_risk_factors s1_business s1_use_of_proceeds s1_dilution s1_capitalization s1_prospectus_summary "
    "proxy_cd_a proxy_exec_compensation proxy_summary_comp_table proxy_pay_vs_performance proxy_summary proxy_governance "
    "6k_results 6k_financial_highlights 6k_mdna 6k_liquidity 6k_outlook 6k_ item_2_02_ item_1_01_ item_5_02_ item_7_01_"
).split()

# Groups of ids that stand for the same section; the first is canonical.
ALIASES = [
    ["item_6_mdna_selected", "item_6_reserved", "item_6_selected_financial_data"],
    ["item_7_mdna", "item_2_mdna", "s1_mdna", "20f_item_5_operating_review"],
    ["item_1a_risk_factors", "part_ii_item_1a_risk_factors", "s1_risk_factors", "20f_item_3d_risk_factors"],
]

# Sections compared in full by default, and the forms that are compared.
FOCUS = (
    "item_1a_risk_factors item_7_mdna part_ii_item_1a_risk_factors item_2_mdna s1_risk_factors s1_mdna s1_business s1_use_of_proceeds s1_dilution "
    "20f_item_3d_risk_factors 20f_item_5_operating_review 20f_item_4_company_information 20f_item_5a_operating_results 20f_item_5b_liquidity 20f_item_4b_business "
    "proxy_exec_compensation proxy_cd_a proxy_governance proxy_summary_comp_table proxy_pay_vs_performance proxy_director_comp "
    "item_2_02_results_of_operations item_5_02_officer_changes item_1_01_material_agreements item_8_01_other item_7_01_reg_fd"
).split()
COMPARED_FORMS = ["10-K", "10-Q", "20-F", "S-1", "DEF 14A", "8-K"]

# Words of each dimension of relevance.
KEYWORDS = {
    "revenue": r"revenues?|net sales|total sales|sales (?:grew|growth|increased?|decreased?|declined?)|bookings|billings|backlog|subscription|recurring|arr|average selling price|pricing|volume|units shipped|same.store|organic growth|segment",
    "margins": r"gross margin|operating margin|net margin|margins?|profitab\w*|operating income|operating loss|operating expenses?|opex|cost of (?:goods|revenue|sales)|sg&a|research and development expense|restructur\w*|cost reduction|efficiency|operating leverage|net income|net loss|earnings per share|eps",
    "cashflow": r"cash flows?|operating cash|free cash flow|capex|capital expenditures?|working capital|cash and cash equivalents|cash position|cash (?:used|provided|generated)|liquidity",
    "balancesheet": r"debt|borrowings|notes payable|credit facilit\w*|revolver|covenants?|interest expense|maturit\w*|refinanc\w*|liabilit\w*|stockholders.? equity|cash balance|leverage|impair\w*|goodwill|going concern",
    "shares": r"share repurchases?|buybacks?|dividends?|share count|shares outstanding|dilut\w*|stock.based compensation|equity awards?|issuances?|secondary offering|stock split|capital return",
    "risk": r"risks?|uncertain\w*|adverse\w*|litigation|lawsuits?|regulat\w*|investigations?|competit\w*|concentration|depend\w* on|cybersecurity|going concern|material weakness|tariffs?|supply chain",
    "management": r"we believe|we expect|we anticipate|we intend|we remain|we continue to|our strategy|outlook|guidance|momentum|demand|confident|well.positioned|on track|record (?:revenue|quarter|year)",
}
_IFRS = {
    "revenue": r"turnover|revenue from contracts with customers",
    "margins": r"operating profit|profit before tax|profit for the (?:year|period)|finance costs?|finance income",
    "cashflow": r"cash generated from operations|net cash (?:inflow|outflow)",
}
# Further words by form.
FORM_KEYWORDS = {
    "DEF 14A": {
        "management": r"base salar\w*|annual incentive|long.term incentive|performance(?:.based)? (?:stock|share) units?|psus?|rsus?|equity awards?|say.on.pay|peer group|compensation committee|pay ratio",
        "shares": r"equity compensation plans?|burn rate|overhang|shares? (?:available|reserved) for (?:future )?issuance|equity awards?|psus?|rsus?",
        "risk": r"clawback|pledg\w*|hedging polic\w*|related.person transactions?|golden parachutes?|change.in.control|severance|audit fees",
    },
    "S-1": {
        "shares": r"use of proceeds|net proceeds|dilution|lock.up|underwriters?|dual.class|super.?voting",
        "risk": r"going concern|accumulated deficit|lock.up|dual.class|no (?:prior )?public market|limited operating history|emerging growth company",
        "cashflow": r"use of proceeds|net proceeds|accumulated deficit|additional (?:capital|financing|funding)",
    },
    "20-F": _IFRS,
    "6-K": _IFRS,
    "8-K": {
        "management": r"definitive agreements?|merger agreements?|preliminary (?:results|financial)|appoint\w*|named as|guidance",
        "risk": r"resign\w*|terminat\w*|impairment charges?|delisting|non.reliance|material weakness|bankruptcy|receivership",
    },
}

# Line items and the facts that may stand for each, the preferred first.
CONCEPTS = [
    ("Revenue", "USD", "us-gaap:RevenueFromContractWithCustomerExcludingAssessedTax us-gaap:RevenueFromContractWithCustomerIncludingAssessedTax us-gaap:Revenues us-gaap:SalesRevenueNet us-gaap:RevenuesNetOfInterestExpense ifrs-full:Revenue ifrs-full:RevenueFromContractsWithCustomers"),
    ("Net interest income", "USD", "us-gaap:InterestIncomeExpenseNet us-gaap:InterestIncomeExpenseAfterProvisionForLoanLoss"),
    ("Noninterest income", "USD", "us-gaap:NoninterestIncome"),
    ("Premiums earned", "USD", "us-gaap:PremiumsEarnedNet"),
    ("Rental revenue", "USD", "us-gaap:RealEstateRevenueNet us-gaap:OperatingLeaseLeaseIncome"),
    ("Gross profit", "USD", "us-gaap:GrossProfit ifrs-full:GrossProfit"),
    ("Operating income", "USD", "us-gaap:OperatingIncomeLoss ifrs-full:ProfitLossFromOperatingActivities"),
    ("Net income", "USD", "us-gaap:NetIncomeLoss ifrs-full:ProfitLossAttributableToOwnersOfParent ifrs-full:ProfitLoss"),
    ("Diluted EPS", "USD/shares", "us-gaap:EarningsPerShareDiluted ifrs-full:DilutedEarningsLossPerShare"),
    ("Basic EPS", "USD/shares", "us-gaap:EarningsPerShareBasic ifrs-full:BasicEarningsLossPerShare"),
    ("Operating cash flow", "USD", "us-gaap:NetCashProvidedByUsedInOperatingActivities ifrs-full:CashFlowsFromUsedInOperatingActivities"),
    ("Total assets", "USD", "us-gaap:Assets ifrs-full:Assets"),
    ("Total liabilities", "USD", "us-gaap:Liabilities ifrs-full:Liabilities"),
    ("Cash & equivalents", "USD", "us-gaap:CashAndCashEquivalentsAtCarryingValue us-gaap:CashCashEquivalentsRestrictedCashAndRestrictedCashEquivalents ifrs-full:CashAndCashEquivalents"),
    ("Diluted shares", "shares", "us-gaap:WeightedAverageNumberOfDilutedSharesOutstanding"),
    ("Shares outstanding", "shares", "dei:EntityCommonStockSharesOutstanding"),
]

#: A lexicon of our own: by type a note and the terms; capitals count where a term has some.
_TERMS = {
    "uncertainty": ("leaves it open", "may|might|could|approximately|subject to change|uncertain|uncertainty|unpredictable|no assurance|contingent|volatility|fluctuate|fluctuations|estimated|we believe|depends on|if any|from time to time|beyond our control"),
    "litigious": ("law and lawsuits", "license|All rights reserved|lawsuit|Public License|licensed under|litigation|plaintiff|plaintiffs|defendant|subpoena|class action|injunction|arbitration|indemnify|alleged|settlement agreement|court ruling"),
    "negative": ("bad news", "threat|loss|losses|worthless|pathetic|stupid|idiot|decline|declined|shortfall|adverse|adversely|impairment|default|bankruptcy|going concern|material weakness|write-down|downgrade|layoffs|restructuring charge|product recall|breach|penalty|penalties|fraud|delisting|weak demand"),
    "constraining": ("ties hands", "required to|restricted from|covenant|covenants|obligated to|limits our ability|prohibited|must comply"),
    "weak_modal": ("hedges", "possibly|this work|appears to|perhaps|seems to|tends to|suggests that|somewhat"),
}

#: The layer below it: single words, by type a note and verbs of which all forms are taken.
_VERBS = {
    "uncertainty": ("a word of doubt", "anticipate|appear|approximate|assume|believe|deviate|differ|doubt|estimate|expose|fluctuate|hesitate|imply|pend|predict|presume|probe|project|reassess|recalculate|reconsider|revise|risk|speculate|suggest|vary|waver"),
    "litigious": ("a word of law", "adjudicate|allege|appeal|arbitrate|attest|claim|contest|convict|depose|enjoin|indemnify|indict|infringe|legislate|license|litigate|mediate|plead|prosecute|rule|settle|stipulate|sue|summon|testify|waive|witness"),
    "negative": ("a word of bad news", "abandon|abuse|aggravate|breach|cancel|close|collapse|complain|concern|damage|decline|default|defraud|delay|delist|deteriorate|diminish|disappoint|disrupt|downgrade|erode|exploit|fail|fall|forfeit|hinder|impair|lose|miss|penalize|recall|resign|restate|shrink|suffer|suspend|terminate|threaten|violate|weaken|worsen"),
    "constraining": ("a word of duty", "bind|commit|compel|comply|confine|constrain|dictate|encumber|forbid|impose|inhibit|limit|mandate|oblige|preclude|prevent|prohibit|require|restrain|restrict|stipulate"),
    "weak_modal": ("a word of hedging", "depend|hint|incline|seem|suppose|tend"),
}


def inflected(verb: str) -> list[str]:
    """The regular forms of a verb."""
    if verb.endswith("e"):
        return [verb, f"{verb}s", f"{verb}d", f"{verb[:-1]}ing"]
    if verb.endswith("y") and verb[-2] not in "aeiou":
        return [verb, f"{verb[:-1]}ies", f"{verb[:-1]}ied", f"{verb}ing"]
    return [verb, f"{verb}{'es' if verb.endswith(('s', 'sh', 'ch')) else 's'}", f"{verb}ed", f"{verb}ing"]


def layered(*layers: list[tuple[str, str, str, bool]]) -> list[tuple[str, str, str, bool]]:
    """Terms (type, term, note, case counts) of all layers; of one type and term, in any case, the first layer's."""
    out: dict[tuple[str, str], tuple[str, str, str, bool]] = {}
    for row in (r for layer in layers for r in layer):
        out.setdefault((row[0], row[1].lower()), row)
    return list(out.values())


PHRASES = [(kind, term, note, term != term.lower()) for kind, (note, terms) in _TERMS.items() for term in terms.split("|")]
WORDS = [(kind, form, note, False) for kind, (note, verbs) in _VERBS.items() for verb in verbs.split("|") for form in inflected(verb)]
LEXICON = layered(PHRASES, WORDS)


def items(form: str) -> list[tuple[str, str, int]]:
    """(item number, section id, order) of an item form."""
    return [(*pair.split(), 10 * (i + 1)) for i, pair in enumerate(_ITEMS[form].split(";"))]


ITEM_FORMS = tuple(_ITEMS)


def keywords(form: str | None = None) -> dict[str, str]:
    """An expression for each dimension: its own words and those of the form."""
    more = FORM_KEYWORDS.get(form or "", {})
    return {d: "|".join(x for x in (KEYWORDS[d], more.get(d)) if x) for d in KEYWORDS}


def bounded(words: str) -> str:
    """Whole words, ASCII borders, in any case."""
    return rf"(?i)(?<![A-Za-z0-9_])(?:{words})(?![A-Za-z0-9_])"
