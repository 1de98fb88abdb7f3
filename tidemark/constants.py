"""Names, codes and lists that results depend on, stated as they are."""

# Metric of each reporting tag, and which tag wins at one time.
TAG_METRICS = {
    "RevenueFromContractWithCustomerExcludingAssessedTax": "revenue",
    "Revenues": "revenue",
    "NetIncomeLoss": "net_income",
    "Assets": "assets",
    "Liabilities": "liabilities",
    "StockholdersEquity": "equity",
    "StockholdersEquityIncludingPortionAttributableToNoncontrollingInterest": "equity_including_nci",
    "CashAndCashEquivalentsAtCarryingValue": "cash",
    "LongTermDebtAndFinanceLeaseObligationsCurrent": "debt_current",
    "LongTermDebtCurrent": "debt_current",
    "LongTermDebtNoncurrent": "debt_noncurrent",
    "LongTermDebt": "debt_total",
    "EarningsPerShareDiluted": "eps_diluted",
}
TAG_PRECEDENCE = {
    "RevenueFromContractWithCustomerExcludingAssessedTax": 20,
    "Revenues": 10,
    "NetIncomeLoss": 20,
    "Assets": 20,
    "Liabilities": 20,
    "StockholdersEquity": 20,
    "StockholdersEquityIncludingPortionAttributableToNoncontrollingInterest": 10,
    "CashAndCashEquivalentsAtCarryingValue": 20,
    "LongTermDebtAndFinanceLeaseObligationsCurrent": 30,
    "LongTermDebtCurrent": 30,
    "LongTermDebtNoncurrent": 30,
    "LongTermDebt": 10,
    "EarningsPerShareDiluted": 20,
}

# The older map of metrics to tags, in which all debt is one metric.
LEGACY_TAGS = {
    "revenue": ("RevenueFromContractWithCustomerExcludingAssessedTax", "Revenues"),
    "net_income": ("NetIncomeLoss",),
    "assets": ("Assets",),
    "liabilities": ("Liabilities",),
    "equity": ("StockholdersEquity", "StockholdersEquityIncludingPortionAttributableToNoncontrollingInterest"),
    "cash": ("CashAndCashEquivalentsAtCarryingValue",),
    "debt": ("LongTermDebtAndFinanceLeaseObligationsCurrent", "LongTermDebtCurrent", "LongTermDebtNoncurrent", "LongTermDebt"),
    "eps_diluted": ("EarningsPerShareDiluted",),
}

# Kinds of securities.
SECURITY_TYPES = ("common_equity", "etf", "leveraged_etf", "inverse_etf", "adr", "preferred", "fund", "warrant", "other")

# Macro series and their feature names.
DEFAULT_SERIES = {
    "EFFR": "effective_federal_funds_rate",
    "DGS2": "treasury_2y",
    "DGS10": "treasury_10y",
    "CPIAUCSL": "cpi",
    "UNRATE": "unemployment_rate",
    "GDPC1": "real_gdp",
    "BAMLH0A0HYM2": "high_yield_spread",
    "VIXCLS": "vix",
    "DTWEXBGS": "broad_dollar_index",
}

# Instruments whose purpose is leveraged or inverse exposure (of universe profiles).
LEVERAGED_INVERSE = (
    "TQQQ", "SQQQ", "SOXL", "SOXS", "UPRO", "SPXU", "SSO", "SDS",
    "QLD", "QID", "FAS", "FAZ", "LABU", "LABD", "TECL", "TECS",
    "TMF", "TMV", "UVXY", "SVXY", "BITX", "BITU", "ETHU", "ETHD",
    "NUGT", "DUST", "JNUG", "JDST", "BOIL", "KOLD", "UCO", "SCO",
    "ERX", "ERY", "DRIP", "GUSH", "YINN", "YANG", "FNGU", "FNGD",
)

# Leveraged or inverse symbols that a panel's universe leaves out.
PANEL_LEVERAGED = (
    "TQQQ", "SQQQ", "SOXL", "SPXL", "UPRO", "TNA", "FAS", "TECL", "LABU", "CURE",
    "DRN", "UDOW", "NAIL", "QLD", "SSO", "DDM", "ROM", "UWM", "AGQ",
)

# Universe profiles, whether they leave out leveraged symbols, and ticker shapes they leave out.
UNIVERSE_PROFILES = {
    "broad": (False, None),
    "core_equity_etf": (True, r"(?i)(?:-WS|-WT|-WW|-UN|-U$|-R$|-P$|_)"),
}

# Default universes.
UNIVERSES = {
    "us_equities": ("equity", ()),
    "fx_major": ("fx", ("EURUSD", "USDJPY", "GBPUSD", "USDCHF", "AUDUSD", "USDCAD", "NZDUSD", "EURGBP", "EURJPY", "GBPJPY")),
    "crypto_liquid": ("crypto", ("BTCUSDT", "ETHUSDT", "SOLUSDT", "BNBUSDT", "XRPUSDT", "ADAUSDT", "DOGEUSDT", "AVAXUSDT", "LINKUSDT", "LTCUSDT")),
    "major_futures": ("future", ("ES", "NQ", "RTY", "CL", "GC", "ZN", "6E")),
    "major_etfs": ("etf", ("SPY", "QQQ", "IWM", "DIA", "TLT", "GLD", "USO", "XLE", "XLK", "XLF")),
}

# Columns of the default experiment feature sets.
QUANT_FEATURES = ("ret_1", "ret_3", "ret_5", "close_to_ma10", "vol_10", "range_pct", "volume_ratio_20")
SENTIMENT_FEATURES = ("sentiment_mean_24h", "sentiment_shock_24h", "news_count_24h", "sentiment", "sentiment_change", "event_surprise", "novelty", "relevance", "credibility")
REGIME_FEATURES = ("volatility_20", "trend_regime", "volatility_regime")
