"""Rules, priors, markers and maps that results must agree with.

They are small; operators turn them into literals or broadcast tables.
"""

from __future__ import annotations

# Domain priors: (cause type, effect, sign, lag, prior); the first of a cause counts.
PRIORS = [
    ("sanctions", "market_drop", "-", "0-1d", 0.75),
    ("rate_hike", "rub_appreciation", "+", "1h-1d", 0.65),
    ("rate_hike", "bank_stock_up", "+", "0-3d", 0.60),
    ("rate_cut", "rub_depreciation", "-", "1h-1d", 0.60),
    ("earnings_beat", "stock_rally", "+", "0-1d", 0.70),
    ("earnings_miss", "stock_drop", "-", "0-1d", 0.75),
    ("guidance_cut", "stock_drop", "-", "0-1d", 0.70),
    ("m&a", "target_stock_up", "+", "0-1d", 0.80),
    ("default", "bond_crash", "-", "0-1h", 0.90),
    ("dividend_cut", "stock_drop", "-", "0-1d", 0.65),
    ("buyback", "stock_up", "+", "0-3d", 0.60),
    ("regulatory", "sector_drop", "-", "1-7d", 0.55),
    ("supply_chain", "production_down", "-", "1-4w", 0.50),
    ("accident", "stock_drop", "-", "0-1d", 0.65),
    ("management_change", "stock_volatility", "±", "0-3d", 0.45),
]

# Lags in seconds, both ends inclusive.
LAGS = {
    "0-1h": (0, 3600),
    "1h-1d": (3600, 86400),
    "0-1d": (0, 86400),
    "0-3d": (0, 259200),
    "1-7d": (86400, 604800),
    "1-4w": (604800, 2419200),
}

# Causal text markers and their confidence.
CAUSAL_MARKERS = {
    0.9: ["привело к", "вызвало", "стало причиной", "caused by", "led to"],
    0.8: ["из-за", "в результате", "вследствие", "повлекло", "спровоцировало", "due to", "because of", "as a result of", "resulted in"],
    0.7: ["в связи с", "следствие"],
    0.6: ["на фоне"],
    0.5: ["после"],
}

# Event markers by type, in order of declaration.
EVENT_MARKERS = {
    "sanctions": ["санкции", "санкц", "ограничени", "запрет", "включить в список", "задержать", "наложить штраф", "инициировать расследование"],
    "rate_hike": ["ключевая ставка", "повысил ставку", "рост ставки", "повышение ставки", "цб повысил", "центральный банк повысил"],
    "rate_cut": ["снижение ставки", "снизил ставку", "понижение ставки", "ставка снижена", "снижена ставка"],
    "earnings": ["прибыль", "выручка", "отчетность", "результаты", "финансовые результаты", "квартальная отчетность", "годовая отчетность"],
    "earnings_miss": ["убыток", "снижение прибыли", "падение прибыли"],
    "earnings_beat": ["рост прибыли", "увеличение прибыли", "рекордная прибыль"],
    "guidance": ["прогноз", "ожидания", "планы", "намерен", "планирует"],
    "guidance_cut": ["снизил прогноз", "ухудшил прогноз", "пересмотрел прогноз"],
    "m&a": ["слияние", "поглощение", "сделка", "приобрет", "купил долю", "m&a"],
    "default": ["дефолт", "банкротство", "невыплата", "технический дефолт"],
    "dividends": ["дивиденды", "дивиденд", "выплата дивидендов"],
    "dividend_cut": ["сократил дивиденды", "снизил дивиденды"],
    "buyback": ["обратный выкуп", "байбэк", "buyback"],
    "ipo": ["ipo", "размещение", "первичное размещение"],
    "regulatory": ["регулятор", "регулирование", "закон", "законопроект", "постановление", "указ", "антимонопольн"],
    "legal": ["суд", "судебн", "иск", "арбитраж", "судебное решение"],
    "management_change": ["новый директор", "смена руководства", "назначен", "ушел в отставку", "покинул пост", "сменил директор"],
    "supply_chain": ["цепочка поставок", "поставк", "логистик", "транспорт", "перебои", "задержка поставок"],
    "production": ["производство", "выпуск", "мощност", "завод"],
    "accident": ["авария", "инцидент", "катастроф", "чп"],
    "strike": ["забастовка", "протест", "остановка работы"],
}
EVENT_PRIORITY = {
    "sanctions": 10, "rate_hike": 9, "rate_cut": 9, "default": 9, "earnings_miss": 8, "earnings_beat": 8, "m&a": 8, "ipo": 8, "earnings": 7,
}
DEFAULT_PRIORITY = 5
ANCHOR_TYPES = ["sanctions", "rate_hike", "rate_cut", "earnings_miss", "earnings_beat", "default", "regulatory", "m&a", "ipo"]

RARITY = {
    "sanctions": 0.9, "default": 0.95, "ipo": 0.85, "m&a": 0.75, "rate_hike": 0.65, "rate_cut": 0.65,
    "earnings_miss": 0.4, "earnings_beat": 0.4, "earnings": 0.3, "dividends": 0.3,
}
DEFAULT_RARITY = 0.5
CREDIBLE_TYPES = ["earnings", "earnings_beat", "earnings_miss", "rate_hike", "rate_cut", "default", "m&a", "ipo"]
BROAD_TYPES = ["sanctions", "regulatory", "macro", "market_crash"]
IMPORTANCE_WEIGHTS = {"novelty": 0.25, "burst": 0.20, "credibility": 0.25, "breadth": 0.15, "price_impact": 0.15}

# Watch rules: (id, level, types, companies, sectors, importance, burst, days); an empty list matches all.
WATCH_RULES = [
    ("critical_sanctions", "L0", ["sanctions"], [], ["banks", "energy", "defense"], 0.8, 2, 7),
    ("default_events", "L0", ["default", "bankruptcy"], [], [], 0.9, 1, 7),
    ("central_bank_rates", "L0", ["rate_hike", "rate_cut"], ["ЦБ РФ", "Bank of Russia"], ["monetary"], 0.7, 1, 7),
    ("major_earnings_surprises", "L0", ["earnings_miss", "earnings_beat"], [], ["banks", "oil_gas", "metals", "telecom"], 0.6, 3, 7),
    ("large_ma_deals", "L0", ["m&a", "acquisition", "merger"], [], ["finance", "energy", "metals"], 0.8, 2, 7),
    ("major_ipo_events", "L0", ["ipo", "public_offering"], [], ["technology", "finance", "energy"], 0.7, 1, 7),
    ("major_accidents", "L0", ["accident", "incident", "disaster"], [], ["transport", "energy", "mining"], 0.9, 1, 7),
    ("macro_regulatory", "L0", ["regulatory", "legislation", "policy"], ["Правительство РФ", "Минфин"], ["macro"], 0.8, 2, 7),
    ("sanctions_market_pattern", "L1", ["sanctions"], [], [], 0.7, 0, 7),
    ("rate_hike_banking_pattern", "L1", ["rate_hike"], [], ["monetary"], 0.6, 0, 5),
    ("earnings_cascade_pattern", "L1", ["earnings_miss", "earnings_beat"], [], ["banking", "oil_gas", "metals"], 0.5, 0, 3),
    ("regulatory_contagion_pattern", "L1", ["regulatory", "legislation"], [], ["finance", "energy", "telecom"], 0.7, 0, 5),
    ("sanctions_consequence_prediction", "L2", ["sanctions"], [], [], 0.8, 0, 14),
    ("election_period_events", "L2", ["regulatory", "policy"], [], [], 0.7, 0, 30),
    ("credit_downgrade_cascade", "L2", ["credit_downgrade", "default"], [], ["finance", "sovereign"], 0.6, 0, 21),
]

# Prediction patterns: (family, source type, predicted types); probability and days go by position.
PREDICTIONS = [
    ("follow_up_events", "sanctions", ["sanctions_compliance", "trade_restrictions", "banking_limitations"]),
    ("follow_up_events", "rate_hike", ["rate_cut", "inflation_response", "market_volatility"]),
    ("follow_up_events", "earnings_beat", ["guidance_update", "dividend_increase", "stock_split"]),
    ("follow_up_events", "merger", ["regulatory_approval", "shareholder_vote", "integration_updates"]),
    ("market_reactions", "volatility_spike", ["index_movements", "currency_changes", "bond_yields"]),
    ("market_reactions", "sector_impact", ["related_companies", "supply_chain_disruptions"]),
    ("market_reactions", "regulatory_response", ["policy_changes", "enforcement_actions"]),
]
PREDICTION_ODDS = {
    "follow_up_events": ([0.7, 0.4, 0.3], [7, 14, 30]),
    "market_reactions": ([0.6, 0.5, 0.3], [3, 7, 14]),
    "timing_patterns": ([0.8, 0.6, 0.4], [5, 10, 21]),
}

# Types that evidence links to a cause or effect type.
SEMANTIC_LINKS = {
    "sanctions": ["trade_restrictions", "banking_limitations", "market_drop", "currency_decline"],
    "rate_hike": ["banking_positive", "bond_yield_up", "currency_strength", "market_reaction"],
    "earnings": ["guidance_update", "dividend_change", "stock_movement", "analyst_update"],
    "merger": ["regulatory_approval", "shareholder_vote", "staff_changes", "financial_details"],
    "market_drop": ["volatility_spike", "liquidity_issues", "panic_selling", "circuit_breakers"],
    "volatility_spike": ["panic_selling", "liquidity_issues", "margin_calls"],
    "trade_restrictions": ["supply_disruption", "price_changes", "company_challenges"],
    "banking_limitations": ["credit_crunch", "liquidity_issues", "financial_stress"],
}
TRUSTED_WORDS = ["медиазона", "блоггер", "коммерсантъ", "meduza", "tass", "рбк"]
SUSPICIOUS_WORDS = ["инсайдер", "утечка", "неофициально", "слухи"]
EVIDENCE_WEIGHTS = {"temporal": 0.3, "semantic": 0.3, "entity": 0.25, "trust": 0.1, "importance": 0.05}

# Anti-spam rules: name, words or pattern, weight.
SPAM_HASHTAGS = [("ad_hashtags", ["#реклама", "#ad", "#promo", "#промо", "#спонсор"], 3.0), ("partner_hashtags", ["#партнер", "#partner", "#collab"], 2.0)]
SPAM_KEYWORDS = [
    ("casino_keywords", ["казино", "ставки", "букмекер", "1xbet", "бонус на депозит"], 5.0),
    ("discount_keywords", ["скидка", "промокод", "распродажа", "акция", "выгодное предложение"], 2.0),
    ("urgency_keywords", ["только сегодня", "осталось мест", "успей купить", "последний день"], 1.5),
    ("crypto_scam", ["криптовалюта заработок", "пассивный доход", "финансовая свобода"], 3.0),
]
SPAM_URLS = [("utm_params", r"[?&](utm_|ref=|partner=)", 2.0), ("shorteners", r"(bit\.ly|tinyurl|clck\.ru|vk\.cc)", 1.5), ("suspicious_tld", r"\.(tk|ml|ga|cf)", 2.0)]
SPAM_STRUCTURE = {"many_urls": 2.0, "forwarded_ad": 3.0, "poll_or_game": 2.0, "short_with_links": 1.5}
WHITELISTED_DOMAINS = ["gov.ru", "cbr.ru", "moex.com", "e-disclosure.ru", "interfax.ru", "rbc.ru", "vedomosti.ru", "kommersant.ru", "tass.ru", "ria.ru"]

# Words left out of company names.
COMPANY_STOP_WORDS = [
    "компания", "группа", "холдинг", "корпорация", "банк", "company", "group", "holding", "corporation", "bank",
    "пао", "оао", "ооо", "ао", "зао", "нко", "нпф", "jsc", "pjsc", "llc", "ltd", "inc", "corp", "plc",
]

# Classifier words, in the order in which they are tried.
SUBTYPES_ONE_COMPANY = [
    ("earnings", ["прибыль", "убыток", "выручка", "earnings", "revenue"]),
    ("guidance", ["прогноз", "forecast", "guidance", "ожидания"]),
    ("ma", ["слияние", "поглощение", "m&a", "acquisition"]),
    ("default", ["дефолт", "банкротство", "default", "bankruptcy"]),
    ("management_change", ["руководство", "менеджмент", "ceo", "cfo"]),
]
MARKET_WORDS = ["рынок", "индекс", "market", "index", "торги"]
REGULATORY_WORDS = ["цб", "цб рф", "банк россии", "регулятор", "санкции"]
SANCTION_WORDS = ["санкции", "sanctions"]
SUBTYPES_OVERRIDE = [
    ("hack", ["хак", "взлом", "hack", "breach", "кибератака"]),
    ("legal", ["суд", "иск", "court", "lawsuit", "правовой"]),
    ("esg", ["экология", "esg", "устойчивость", "sustainability"]),
    ("supply_chain", ["логистика", "поставки", "supply chain", "цепочка"]),
    ("tech_outage", ["технический сбой", "outage", "сбой системы"]),
]
TAG_WORDS = [
    ("dividends", ["дивиденды", "dividend", "выплата"]),
    ("bonds", ["облигации", "bonds", "долг"]),
    ("equity", ["акции", "shares", "equity"]),
    ("ai", ["ии", "искусственный интеллект", "ai", "машинное обучение"]),
    ("crypto", ["блокчейн", "криптовалюта", "blockchain", "crypto"]),
    ("green", ["зеленые", "green", "энергия", "renewable"]),
    ("social", ["социальная ответственность", "social responsibility"]),
    ("quarterly", ["квартал", "quarter", "q1", "q2", "q3", "q4"]),
    ("annual", ["год", "year", "годовой", "annual"]),
]
TOPIC_WORDS = [
    ("финансы", ["прибыль", "убыток", "выручка", "earnings", "revenue", "финансы"], 0.8),
    ("акции", ["акции", "shares", "equity", "тикер", "бирж"], 0.7),
    ("облигации", ["облигации", "bonds", "долг", "кредит"], 0.7),
    ("рынок", ["рынок", "market", "индекс", "index", "торги"], 0.8),
    ("энергетика", ["нефть", "oil", "газ", "gas", "энергия"], 0.8),
    ("банки", ["банк", "bank", "кредит", "credit"], 0.8),
    ("технологии", ["технологии", "tech", "ии", "ai", "цифр"], 0.7),
    ("регулирование", ["цб", "регулятор", "санкции", "закон"], 0.9),
]
COUNTRY_PATTERNS = {
    "RU": [r"\bросси[яи]\b", r"\bроссийск[аяой]\b", r"\bрф\b", r"\bроссия\b"],
    "US": [r"\bсша\b", r"\bамерик[аи]\b", r"\bамериканск[аяой]\b", r"\busa\b"],
    "CN": [r"\bкита[йя]\b", r"\bкитайск[аяой]\b", r"\bchina\b"],
    "DE": [r"\bгермани[яи]\b", r"\bнемецк[аяой]\b", r"\bgermany\b"],
    "GB": [r"\bвеликобритани[яи]\b", r"\bбритани[яи]\b", r"\bангли[яи]\b", r"\buk\b"],
    "FR": [r"\bфранци[яи]\b", r"\bфранцузск[аяой]\b", r"\bfrance\b"],
    "JP": [r"\bяпони[яи]\b", r"\bяпонск[аяой]\b", r"\bjapan\b"],
    "CA": [r"\bканад[аы]\b", r"\bканадск[аяой]\b", r"\bcanada\b"],
    "IN": [r"\bинди[яи]\b", r"\bиндийск[аяой]\b", r"\bindia\b"],
    "BR": [r"\bбразили[яи]\b", r"\bбразильск[аяой]\b", r"\bbrazil\b"],
}
LANGUAGE_COUNTRY = {"ru": "RU", "en": "US", "zh": "CN", "de": "DE", "fr": "FR", "ja": "JP", "es": "ES", "pt": "BR", "it": "IT", "ko": "KR", "ar": "SA", "hi": "IN"}

# Sector by ticker (industry codes); of two entries the later one counts.
TICKER_SECTOR = {
    "GAZP": "1010", "ROSN": "1010", "LKOH": "1010", "NVTK": "1010", "SNGS": "1010", "TATN": "1010", "SIBN": "1010",
    "GMKN": "2040", "NLMK": "2030", "CHMF": "2030", "MAGN": "2030", "PLZL": "2040", "ALRS": "2040", "RUAL": "2040", "POGR": "2040",
    "PHOR": "2010", "KAZT": "2010", "NKNC": "2010", "AKRN": "2010", "SBER": "9010", "VTBR": "9010", "CBOM": "9010", "BSPB": "9010",
    "QIWI": "9050", "TCSG": "9510", "MGNT": "6010", "FIVE": "6010", "DSKY": "6010", "LENT": "6010", "OZON": "6010", "MVID": "6010",
    "MTSS": "7020", "MFON": "7020", "RTKM": "7010", "YNDX": "9510", "VKCO": "9510", "POSI": "9510", "HHRU": "9510", "CIAN": "9510",
    "ABRD": "4040", "AQUA": "4040", "BELU": "4040", "GCHE": "4040", "AFLT": "3050", "NMTP": "3050", "FESH": "3050", "GLTR": "3050",
    "PIKK": "9040", "LSRG": "9040", "SMLT": "9040", "ETLN": "9040", "HYDR": "8010", "IRAO": "8010", "FEES": "8010", "UPRO": "8010",
    "TGKA": "8010", "TGKB": "8010", "OGKB": "8010", "MDMG": "5010",
}
KEYWORD_SECTOR = [
    ("1010", ["нефть", "газ", "нефтегаз", "энергия", "oil", "gas", "energy", "petroleum"]),
    ("9010", ["банк", "кредит", "финансы", "банковский", "bank", "credit", "finance", "lending"]),
    ("9510", ["технологии", "софт", "интернет", "цифровой", "technology", "software", "internet", "digital"]),
    ("6010", ["ритейл", "торговля", "магазин", "продажи", "retail", "trade", "store", "sales"]),
    ("2030", ["металлы", "металлургия", "metals", "steel", "iron"]),
    ("2040", ["добыча", "шахта", "mining"]),
    ("7020", ["связь", "телеком", "мобильный", "сеть", "telecom", "mobile", "network", "communication"]),
    ("8010", ["электроэнергия", "энергетика", "электричество", "electricity", "power", "utility"]),
    ("9040", ["недвижимость", "строительство", "девелопмент", "real estate", "construction", "property"]),
]
# Company aliases: alias, ticker.
ALIASES = {
    "сбер": "SBER", "сбербанк": "SBER", "sberbank": "SBER", "сберегательный банк": "SBER", "сбербанк россии": "SBER",
    "газпром": "GAZP", "газ": "GAZP", "gazprom": "GAZP", "втб": "VTBR", "vtb": "VTBR", "втб банк": "VTBR",
    "роснефть": "ROSN", "rosneft": "ROSN", "лукойл": "LKOH", "lukoil": "LKOH", "лук": "LKOH", "яндекс": "YNDX", "yandex": "YNDX", "яндекс нв": "YNDX",
}

# Seconds: windows of impact and their lookbacks; days: windows of correlation.
IMPACT_WINDOWS = {"15m": (900, 3600), "1h": (3600, 14400), "1d": (86400, 86400), "5d": (432000, 432000)}
CORRELATION_DAYS = {"1M": 30, "3M": 90, "6M": 180, "1Y": 365, "2Y": 730, "5Y": 1825}

# Industry codes: code, name, parent.
INDUSTRIES = [
    ("1000", "Oil & Gas", None), ("2000", "Basic Materials", None), ("3000", "Industrials", None), ("4000", "Consumer Goods", None),
    ("5000", "Health Care", None), ("6000", "Consumer Services", None), ("7000", "Telecommunications", None), ("8000", "Utilities", None),
    ("9000", "Financials", None), ("9500", "Technology", None),
    ("1010", "Oil & Gas Producers", "1000"), ("1020", "Oil Equipment & Services", "1000"),
    ("2010", "Chemicals", "2000"), ("2020", "Forestry & Paper", "2000"), ("2030", "Industrial Metals", "2000"), ("2040", "Mining", "2000"),
    ("3010", "Aerospace & Defense", "3000"), ("3020", "General Industrials", "3000"), ("3030", "Electronic & Electrical Equipment", "3000"),
    ("3040", "Industrial Engineering", "3000"), ("3050", "Industrial Transportation", "3000"),
    ("4010", "Automobiles & Parts", "4000"), ("4020", "Beverages", "4000"), ("4030", "Food & Drug Retailers", "4000"), ("4040", "Food Producers", "4000"),
    ("4050", "Household Goods", "4000"), ("4060", "Personal Care", "4000"), ("4070", "Tobacco", "4000"),
    ("5010", "Health Care Equipment & Services", "5000"), ("5020", "Pharmaceuticals & Biotechnology", "5000"),
    ("6010", "General Retailers", "6000"), ("6020", "Leisure & Hotels", "6000"), ("6030", "Media", "6000"), ("6040", "Support Services", "6000"), ("6050", "Travel & Tourism", "6000"),
    ("7010", "Fixed Line Telecommunications", "7000"), ("7020", "Mobile Telecommunications", "7000"), ("7030", "Telecommunications Equipment", "7000"),
    ("8010", "Electricity", "8000"), ("8020", "Gas, Water & Multi-utilities", "8000"),
    ("9010", "Banks", "9000"), ("9020", "Non-life Insurance", "9000"), ("9030", "Life Insurance", "9000"), ("9040", "Real Estate", "9000"), ("9050", "Financial Services", "9000"),
    ("9510", "Software & Computer Services", "9500"), ("9520", "Technology Hardware & Equipment", "9500"),
]
# Top sectors of two other taxonomies.
GICS = {"10": "Energy", "15": "Materials", "20": "Industrials", "25": "Consumer Discretionary", "30": "Consumer Staples", "35": "Health Care", "40": "Financials", "45": "Information Technology", "50": "Communication Services", "55": "Utilities", "60": "Real Estate"}
NACE = {
    "A": "Agriculture, Forestry and Fishing", "B": "Mining and Quarrying", "C": "Manufacturing", "D": "Electricity, Gas, Steam and Air Conditioning Supply",
    "E": "Water Supply; Sewerage, Waste Management and Remediation Activities", "F": "Construction", "G": "Wholesale and Retail Trade; Repair of Motor Vehicles and Motorcycles",
    "H": "Transportation and Storage", "I": "Accommodation and Food Service Activities", "J": "Information and Communication", "K": "Financial and Insurance Activities",
    "L": "Real Estate Activities", "M": "Professional, Scientific and Technical Activities", "N": "Administrative and Support Service Activities",
    "O": "Public Administration and Defence; Compulsory Social Security", "P": "Education", "Q": "Human Health and Social Work Activities",
    "R": "Arts, Entertainment and Recreation", "S": "Other Service Activities", "T": "Activities of Households as Employers", "U": "Activities of Extraterritorial Organizations and Bodies",
}
TAXONOMIES = {"icb": INDUSTRIES, "gics": [(k, v, None) for k, v in GICS.items()], "nace": [(k, v, None) for k, v in NACE.items()]}

# Glossary of the built-in extractor: name, (ticker, sector) or kind.
GLOSSARY_COMPANIES = {
    "ГАЗПРОМ": ("GAZP", "Нефть и газ"), "ЛУКОЙЛ": ("LKOH", "Нефть и газ"), "СБЕРБАНК": ("SBER", "Финансы"), "СБЕР": ("SBER", "Финансы"), "ВТБ": ("VTBR", "Финансы"),
    "ЯНДЕКС": ("YNDX", "Технологии"), "НОРНИКЕЛЬ": ("GMKN", "Металлургия"), "РОСНЕФТЬ": ("ROSN", "Нефть и газ"), "НОВАТЭК": ("NVTK", "Нефть и газ"), "МАГНИТ": ("MGNT", "Ритейл"),
    "X5": ("FIVE", "Ритейл"), "ОЗОН": ("OZON", "E-commerce"), "МТС": ("MTSS", "Телеком"), "МЕГАФОН": ("MFON", "Телеком"),
}
GLOSSARY_MARKETS = {"ММВБ": "индекс", "IMOEX": "индекс", "РТС": "индекс", "RTSI": "индекс", "MOEX": "биржа", "МОСБИРЖА": "биржа", "СПБ": "биржа"}
METRIC_WORDS = {"прибыл": "прибыль", "выручк": "выручка", "дивиденд": "дивиденды", "убыт": "убыток"}

# Exchanges: open and close, local hours.
EXCHANGE_HOURS = {"MOEX": (10, 19, "Europe/Moscow"), "NYSE": (9, 16, "America/New_York"), "NASDAQ": (9, 16, "America/New_York")}
