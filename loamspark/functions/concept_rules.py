"""Fixed values of concepts, their health, importance and relationships, and of owners of facts."""

#: Categories that form concepts, with the baseline scores for business, assistant and customer.
BASELINES = {
    "pricing_plan": (95, 95, 95),
    "policy": (62, 68, 68),
    "product": (62, 62, 58),
    "service": (62, 65, 62),
    "contact_information": (42, 48, 48),
    "industry_served": (55, 55, 52),
    "integration": (55, 58, 55),
    "certification": (55, 58, 55),
    "location_service_area": (35, 38, 38),
}

#: What a category's statements should say somewhere, by the name of its absence. (Case counts where marked.)
SIGNALS = (
    ("pricing_plan", "missing_price", r"(?:[$£€]\s?\d|\d+(?:\.\d+)?\s?(?:usd|gbp|eur)|\bfree\b)", True),
    ("pricing_plan", "missing_billing_period", r"\b(?:per\s+(?:month|year|week|day)|monthly|annual(?:ly)?|yearly|weekly|daily|one[- ]time)\b", True),
    ("pricing_plan", "missing_included_features", r"\b(?:includes?|features?|comes with)\b", True),
    ("policy", "missing_effective_rule", r"\b(?:will|must|may|can|cannot|eligible|allowed|prohibited|refund(?:ed)?|return(?:ed)?|cancel(?:led|ed)?)\b", True),
    ("policy", "missing_timeframe", r"\b(?:\d+\s*(?:business\s+)?(?:hours?|days?|weeks?|months?|years?)|immediately|at any time)\b", True),
    ("policy", "missing_conditions", r"\b(?:if|when|unless|within|provided|requires?|eligible|condition|except)\b", True),
    ("contact_information", "missing_contact_value", r"(?:[\w.+-]+@[\w.-]+\.[a-z]{2,}|\+?\d[\d ().-]{7,}\d|https?://)", True),
    ("contact_information", "missing_contact_purpose", r"\b(?:support|sales|billing|general|contact|call|email|phone)\b", True),
    ("location_service_area", "missing_location_name", r"\b(?:located|based|office|address|in\s+[A-Z][\w.-]+)\b", False),
    ("location_service_area", "missing_service_area_detail", r"\b(?:serves?|serving|service area|nationwide|worldwide|region|within|across)\b", True),
    ("service", "missing_description", r"^\s*\S.{18,}\S\s*$", True),
    ("product", "missing_description", r"^\s*\S.{18,}\S\s*$", True),
)

#: Wording that moves importance.
WORDING = {
    "primary": r"\b(?:primary|core|flagship|main|most popular|recommended|best for)\b",
    "required": r"\b(?:required|mandatory|essential|unavailable without)\b",
    "included": r"\bincluded\b",
    "secondary": r"\b(?:secondary|peripheral|minor|additional office|alternate contact)\b",
    "rights": r"\b(?:refunds?|cancell?ation|cancell?ing|cancelled|privacy|warrant(?:y|ies)|guarantee[sd]?|eligib(?:le|ility)|qualif(?:y|ies|ication)|requirements?)\b",
    "help": r"\b(?:support|billing)\b",
    "official": r"\bofficial\b",
    "safety": r"\b(?:security|secure|soc\s*[123]|hipaa|compliance|compliant|gdpr|pci(?:[- ]dss)?|iso\s*27001)\b",
    "availability": r"\b(?:available|availability|service area|serves|serving|nationwide|worldwide)\b",
}

#: Wording, categories it counts for (none: all), whether it adds or sets a floor, and the three amounts.
ADJUSTMENTS = (
    ("primary", ("product", "service"), "add", (18, 12, 12)),
    ("required", (), "add", (15, 15, 15)),
    ("included", ("product", "service", "integration"), "add", (5, 5, 5)),
    ("secondary", ("product", "service", "contact_information", "location_service_area"), "add", (-22, -22, -22)),
    ("rights", ("policy",), "floor", (90, 95, 95)),
    ("help", ("contact_information",), "floor", (72, 80, 78)),
    ("official", ("contact_information", "certification"), "add", (5, 5, 5)),
    ("safety", (), "floor", (75, 80, 75)),
    ("availability", ("service", "location_service_area"), "floor", (-1000, 68, 65)),
)
SHARES = (0.4, 0.35, 0.25)

#: Words of names that are written as acronyms, and what a namespace adds to a name.
ACRONYMS = {"ai": "AI", "api": "API", "gdpr": "GDPR", "hipaa": "HIPAA", "iso": "ISO", "seo": "SEO", "sms": "SMS", "soc": "SOC", "sso": "SSO", "ui": "UI", "url": "URL"}
SUFFIXES = {"pricing_plan": "Plan", "policy": "Policy"}

_INCLUDES = r"\b(?:includes?|included|features?|comes?\s+with)\b"
_SERVES = r"\b(?:serves?|serving|built|designed)\s+(?:for\s+)?\b"
_PART = r"\b(?:part\s+of|belongs?\s+to|available\s+(?:on|with)|included\s+in)\b"
_APPLIES = r"\b(?:appl(?:y|ies|ied)\s+to|covers?|governs?)\b"
_HELPS = r"\b(?:contact|email|call|handles?|for|supports?)\b"
_AREA = r"\b(?:serves?|serving|provides?|offers?)\b"

#: Pairs of categories that may be related, the relation, and the words that must stand between the names.
RELATIONS = (
    ("pricing_plan", "product", "includes", _INCLUDES),
    ("pricing_plan", "service", "includes", _INCLUDES),
    ("product", "integration", "integrates_with", r"\bintegrat(?:es?|ed|ion)\s+(?:with\s+)?\b"),
    ("product", "industry_served", "serves", _SERVES),
    ("service", "industry_served", "serves", _SERVES),
    ("service", "location_service_area", "available_in", r"\b(?:available|offered|provided)\s+(?:in|across|throughout)\b"),
    ("product", "pricing_plan", "belongs_to", _PART),
    ("service", "pricing_plan", "belongs_to", _PART),
    ("policy", "pricing_plan", "applies_to", _APPLIES),
    ("policy", "product", "applies_to", _APPLIES),
    ("policy", "service", "applies_to", _APPLIES),
    ("contact_information", "policy", "contact_for", _HELPS),
    ("contact_information", "pricing_plan", "contact_for", _HELPS),
    ("contact_information", "product", "contact_for", _HELPS),
    ("contact_information", "service", "contact_for", _HELPS),
    ("location_service_area", "service", "serves", _AREA),
    ("location_service_area", "product", "serves", _AREA),
)

#: The owner of each category; all others belong to operations_context.
OWNERS = {
    "business_identity": ("business_identity", "company_overview", "contact_information", "contact", "location_service_area", "location", "certification", "partnership"),
    "commercial": ("product", "service", "pricing_plan", "pricing", "feature_capability", "integration", "ai_automation", "technical_capability"),
    "market_customer": ("customer_segment", "customer", "industry_served", "industry", "primary_use_case", "mission_value_proposition", "brand_voice_terminology"),
    "proof_authority": ("competitive_differentiator", "differentiator", "additional_business_knowledge"),
}
LANES = {
    "business_identity": ("core_business", "market_customer", "operations", "technical", "unknown"),
    "commercial": ("core_business", "commercial", "technical"),
    "market_customer": ("core_business", "commercial", "market_customer"),
    "proof_authority": ("core_business", "commercial", "proof", "market_customer"),
    "operations_context": ("operations", "legal", "technical", "editorial", "core_business", "unknown"),
}
CLAIMS = {
    "area": r"\b(?:located|based|serve|serves|serving|service area|available in|available throughout|office|offices|surrounding area|operates? in|ships? to|delivery to)\b",
    "call_to_act": r"^(?:set up|schedule|book|connect|contact|call|click|learn more|read more|view more|start|join)\b",
    "advice": r"\b(?:should|consider|tips?|best practices?|how to|ways to)\b",
    "policy": r"\b(?:refund|return|privacy|terms|policy|non-refundable|customer(?:'s|s') responsibility|data collection|personal information)\b",
    "navigation": r"^(?:scroll down|click here|learn more|read more|view more|order now|shop now|contact us|call now|see what we offer)\b",
    "referral": r"\b(?:provide (?:you )?with .*recommendations?|refer you to|local recommendations?|consult (?:an|a)|you should|consider|tips?|best practices?)\b",
    "sells": r"\b(?:we|our|company|agency|firm|studio|practice|provider|team)\b.{0,60}\b(?:offer|offers|provide|provides|deliver|delivers|sell|sells|specialize|specializes|build|builds|create|creates|design|designs|manage|manages|implement|implements|support|supports)\b",
    "prices": r"\b(?:price|pricing|fee|rate|plan|package|tier|subscription|membership|special|promotion|discount|offer|starting at|from only|per month|per year)\b",
    "money": r"[$£€]\s?\d",
    "dealing": r"\b(?:fee|price|cost|plan|package|special|promotion|discount|per|starting|add|setup|size|side|month|year)\b",
    "teaching": r"\b(?:should|consider|tips?|best practices?|how to|ways to|you can|you should|marketers? should|businesses should)\b",
    "first_party": r"\b(?:we|our|us|company|agency|firm|studio|practice|provider|team)\b",
    "audience": r"\b(?:serves?|serving|built for|designed for|customers? (?:include|are)|clients? (?:include|are)|users? (?:include|are)|audience includes?|ideal for|for (?:small|mid-sized|large|local|enterprise|nonprofit|professional|consumer|business))\b",
    "use_case": r"\b(?:helps?|used (?:to|for)|designed to|built to|enables?|solves?|supports?|improves?|reduces?|increases?|manages?|automates?|creates?|tracks?|connects?|drives?|maximi[sz]es?)\b",
    "constraint": r"^(?:\*?special order only!?|we only offer|available only|limited to|cost is based on)\b",
    "proof": r"\b(?:testimonial|review|recommend|case study|success story|result|results|outcome|rating|stars?|award|recognized|licensed|certified|years? of experience|over \d+ years|more than \d+ years|served \d+|sold \d+|generated|increased|reduced|saved|delivered)\b",
    "difference": r"\b(?:unique|proprietary|exclusive|specializ(?:e|es|ed|ing)|award-winning|only provider|recognized for|known for|leading|decades? of experience|years? of experience|proven)\b",
}
AMOUNT, ADD_ON = r"[$£€]\s?\d+(?:\.\d+)?", r"\b(?:fee|add|setup|size|double sided|per foot|per month|per year|quantity|cost|price)\b"
