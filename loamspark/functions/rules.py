"""Rule tables of the fact engine: patterns, lanes and maps. All entries are fixed values."""

from __future__ import annotations

from typing import NamedTuple


class Rule(NamedTuple):
    category: str
    title: str
    evidence: str
    pages: tuple[str, ...] = ()
    heading: str = ""
    ignore_case: bool = True


# The extraction rules.
RULES = (
    Rule("pricing_plan", "Pricing or offer", r"(?:[$£€]\s?\d|\b(?:special|offer|promotion|discount|pricing|price|plan|package|tier|subscription|trial)\b.{0,100}(?:[$£€]\s?\d|\bfree\b)|(?:[$£€]\s?\d).{0,100}\b(?:special|offer|promotion|trial|package|plan|subscription|service)\b)"),
    Rule("contact_information", "Contact method", r"(?:[\w.+-]+@[\w.-]+\.[a-z]{2,}|(?:\+?\d[\d ().-]{7,}\d)|\b(?:email|call|phone|contact)\b)", ("contact", "support", "home")),
    Rule("policy", "Policy", r"\b(?:refund|return|cancel(?:lation)?|privacy policy|warranty|guarantee|terms of use|data retention|personal information|opt[- ]out|deletion request)\b", ("policies",)),
    Rule("location_service_area", "Location or service area", r"\b(?:located|based|serv(?:e|es|ing|ice area)|office|available (?:in|throughout)|service area|surrounding area|surrounding areas|nationwide|worldwide)\b"),
    Rule("integration", "Integration", r"\b(?:integrates? with|integration|connects? (?:to|with)|compatible with|plugin for)\b", ("integrations", "technical")),
    Rule("security_compliance", "Security and compliance", r"\b(?:encrypted?|encryption|soc ?(?:2|ii)|gdpr|hipaa|iso ?27001|sso|mfa|multi-factor authentication|penetration testing|data encryption)\b", ("security", "compliance", "technical", "certifications")),
    Rule("certification", "Credential or certification", r"\b(?:licensed|license(?:d)?|certified|certification|accredited|accreditation|degree from|board[- ]certified|credentialed|registered)\b"),
    Rule("support_onboarding", "Process or onboarding", r"\b(?:support|onboarding|implementation|training|help desk|response time|getting started|first visit|first session|first meeting|initial evaluation|initial assessment|consultation|discovery call|follow[- ]up|setup|installation|kickoff|roadmap|review of findings)\b"),
    Rule("partnership", "Partnership", r"\b(?:partner(?:ship|ed)?|affiliate|reseller)\b", ("partnerships", "about")),
    Rule("customer_segment", "Customer segment", r"\b(?:built for|designed for|serves?|serving|helping|customers? (?:are|include)|clients? (?:are|include)|users? (?:are|include)|teams? in|businesses? in|organizations? in|people (?:with|who))\b"),
    Rule("industry_served", "Industry served", r"\b(?:industries? (?:we )?serve|solutions? for|serving the)\b", ("industries",)),
    Rule("primary_use_case", "Primary use case", r"\b(?:use case|helps? (?:you|teams|customers|clients|users)|used (?:to|for)|designed to|built to|enables?|solves?|supports?|improves?|reduces?|increases?|manages?|automates?|creates?|tracks?|connects?)\b"),
    Rule("ai_automation", "AI and automation capability", r"\b(?:artificial intelligence|machine learning|\bAI\b|automat(?:e|es|ed|ion)|agentic)\b", ("products", "services", "technical", "home", "use_cases"), r"\b(ai|automation|intelligence|agent|feature|capabilit)\b", False),
    Rule("technical_capability", "Technical capability", r"\b(?:api|sdk|webhook|developer|cloud|self-hosted|architecture|data export)\b", ("technical",)),
    Rule("product", "Product", r"\b(?:product|platform|software|app|application|suite|tool)\b", ("products",), r"."),
    Rule("service", "Service", r"\b(?:we (?:offer|provide|deliver)|our services? include|offers?|provides?|specializes? in|specializing in|consulting|implementation|managed service|professional service|maintenance|support service|design service|development service|marketing service|training service)\b"),
    Rule("feature_capability", "Feature or capability", r"\b(?:features?|capabilit|includes?|enables?|allows? (?:you|teams|customers|users)|can (?:create|manage|track|connect|generate|automate|analyze|monitor|export|integrate))\b", ("products", "services", "technical", "home")),
    Rule("mission_value_proposition", "Mission and value proposition", r"\b(?:our mission|we exist to|we believe|helps? .{2,60} (?:save|grow|reduce|increase|improve|simplify|accelerate)|so you can|core values?|philosophy|approach)\b", ("about", "home")),
    Rule("competitive_differentiator", "Competitive differentiator", r"\b(?:unlike|only|unique|proprietary|award-winning|differentiates?|without (?:the|any)|faster than|more than \d+ years|over \d+ years|advanced|proven methods?|goes above and beyond|best results|exclusive|specialized)\b", ("about", "home", "products", "services")),
    Rule("company_overview", "Company overview", r"\b(?:we are|founded|our company|our team|specializes? in|practice|firm|agency|studio|company|business|organization)\b", ("about", "home")),
    Rule("brand_voice_terminology", "Brand terminology", r"\b(?:we call (?:this|it|our)|known as|referred to as|our (?:method|framework|approach)|core values?|signature process|proprietary method|named framework)\b"),
    Rule("additional_business_knowledge", "Case study", r"\b(?:case study|resulted in|increased|reduced|grew|saved|delivered)\b", ("case_studies",), r"."),
    Rule("additional_business_knowledge", "Customer proof", r"\b(?:testimonial|review|reviews|customer said|client said|user said|recommend|highly recommend|life-changing|worked wonders|customer service|helped me tremendously|made a big difference|five stars?|5 stars?)\b"),
    Rule("faq", "FAQ", r"\b(?:faq|frequently asked|how long|how much|who is|can i|do you|what happens|what is included|how does|when should|what should|is .* safe|is .* available)\b"),
)

#: The words one of which each rule's evidence needs, in its own wording, by their first letter; a test holds them against RULES.
WORDS = {
    "a": "gency|gentic|pi|pp|pplication|pproach|rchitecture|rtificial intelligence|ccreditation|ccredited|dvanced|ffiliate|llows?|utomat(?:es?|ed|ion)|vailable|ward-winning",
    "b": "ased|est results|oard[- ]certified|uilt (?:for|to)|usiness|usinesses? in",
    "c": "all|an (?:i|analyze|automate|connect|create|export|generate|integrate|manage|monitor|track)|ancel(?:lation)?|apabilit|ase study|ertification|ertified|lients? (?:are|include)|lient said|loud|ompany|ompatible with|onnects?|onsultation|onsulting|ontact|ore values?|redentialed|reates?|ustomers? (?:are|include)|ustomer (?:said|service)",
    "d": "ata (?:encryption|export|retention)|egree from|eletion request|elivered|esign service|esigned (?:for|to)|eveloper|evelopment service|ifferentiates?|iscount|iscovery call|o you",
    "e": "mail|nables?|ncrypted?|ncryption|xclusive",
    "f": "aq|aster than|eatures?|irm|irst (?:meeting|session|visit)|ive stars?|ollow[- ]up|ounded|requently asked",
    "g": "dpr|etting started|oes above and beyond|rew|uarantee",
    "h": "elp desk|elped me tremendously|elping|elps?|ighly recommend|ipaa|ow (?:does|long|much)",
    "i": "mplementation|mproves?|ncludes?|ncreased|ncreases?|ndustries? (?:we )?serve|nitial (?:assessment|evaluation)|nstallation|ntegrates? with|ntegration|so ?27001",
    "k": "ickoff|nown as",
    "l": "icensed?|ife-changing|ocated",
    "m": "achine learning|ade a big difference|aintenance|anaged service|anages?|arketing service|fa|ore than|ulti-factor authentication",
    "n": "amed framework|ationwide",
    "o": r"ffers?|ffice|nboarding|nly|pt[- ]out|rganization|rganizations? in|ur (?:approach|company|framework|method|mission|services? include|team)|ver \d+ years",
    "p": "ackage|artner(?:ship|ed)?|enetration testing|eople (?:who|with)|ersonal information|hilosophy|hone|lan|latform|lugin for|ractice|rice|ricing|rivacy policy|roduct|rofessional service|romotion|roprietary|roven methods?|rovides?",
    "r": "ecommend|educed|educes?|eferred to as|efund|egistered|eseller|esponse time|esulted in|eturn|eviews?|oadmap",
    "s": "afe|aved|dk|elf-hosted|erves?|ervice area|erving|etup|ignature process|o you can|oc ?(?:2|ii)|oftware|olutions? for|olves?|pecial|pecialized|pecializes? in|pecializing in|so|tudio|ubscription|uite|upports?|urrounding areas?",
    "t": "eams? in|erms of use|estimonial|ier|ool|racks?|raining|rial",
    "u": "nique|nlike|se case|sed (?:for|to)|sers? (?:are|include)|ser said",
    "w": "arranty|e (?:are|believe|call|deliver|exist to|offer|provide)|ebhook|hat (?:happens|is included|should)|hen should|ho is|ithout (?:any|the)|orked wonders|orldwide",
    "5": " stars?",
}
#: What evidence without one of these words needs: an amount, an address, AI in capitals, or a number to call.
SIGNS, DIGITS = ("$", "£", "€", "@", "AI"), r"\d[\d ().-]{7,}\d"

# Priorities of categories; the rest have 70.
PRIORITY = {
    "pricing_plan": 110, "service": 105, "product": 105, "primary_use_case": 100, "competitive_differentiator": 95,
    "certification": 94, "location_service_area": 92, "support_onboarding": 90, "faq": 88, "additional_business_knowledge": 86,
    "customer_segment": 82, "contact_information": 70, "feature_capability": 70, "integration": 65, "policy": 30, "security_compliance": 25,
}
ORDERED = tuple(sorted(RULES, key=lambda r: -PRIORITY.get(r.category, 70)))

# Categories that privacy and tracking sentences do not support.
COMMERCIAL = (
    "pricing_plan", "product", "service", "feature_capability", "customer_segment", "industry_served", "primary_use_case",
    "location_service_area", "competitive_differentiator", "mission_value_proposition", "certification", "support_onboarding",
    "brand_voice_terminology", "additional_business_knowledge",
)

# Sentence and block filters.
CHROME = r"^(skip to (?:main )?content|accept (?:all )?cookies?|cookie settings|privacy preferences|subscribe(?: to our newsletter)?|follow us|all rights reserved|© ?\d{4}|menu|close menu|back to top|get started|learn more|read more|contact us)$"
#: No chrome text has more characters, and each text that the filter of repeated ones drops has one of these words.
CHROME_LENGTH, REPEATED_WORDS = 40, ("newsletter", "cookie", "accessibility", "follow", "terms")
REPEATED_KEPT = r"\b(price|refund|cancel|support|email|phone|address|location|service|policy|hours?)\b"
REPEATED_DROPPED = r"\b(?:newsletter|cookie preferences|accessibility menu|follow us on|terms of website use)\b"
CONTRACT = r"\b(?:may include|may update|may modify|may improve|may discontinue|does not guarantee|cannot guarantee|limits may vary|covered items may include|service commitments covered items|lost revenue or business opportunities|third-party service failures|subject to change|at any time without notice)\b"
TRACKING = r"\b(?:personal information|personally identifiable|ip address|cookies?|pixels?|advertisers?|advertising partners?|do not track|\bdnt\b|browser information|device information|tracking technolog|data collection|data retention|third[- ]party sites?|services usage|consumer privacy|ccpa)\b"
STANDARD = r"\b(?:soc ?(?:2|ii)|hipaa|iso ?27001|gdpr)\b"
GENERIC_TITLE = r"^(features?|capabilit(?:y|ies)|overview|details?|information|home|about|services?|products?|contact|faq)$"

# Page types, in order; the first pattern that the page's signals match wins.
PAGE_TYPES = (
    ("pricing", r"\b(pric|plans?|packages?)\b"), ("faq", r"\b(faq|questions?|help center)\b"),
    ("case_studies", r"\b(case stud(?:y|ies)|success stor(?:y|ies)|customer stor(?:y|ies))\b"), ("testimonials", r"\b(testimonials?|reviews?)\b"),
    ("security", r"\b(security|trust center)\b"), ("compliance", r"\b(compliance|privacy|gdpr|hipaa|soc 2)\b"),
    ("certifications", r"\b(certif|accredit)\b"), ("integrations", r"\b(integrations?|connectors?|apps?)\b"),
    ("locations", r"\b(locations?|service areas?|find us)\b"), ("contact", r"\b(contact|call us|email us)\b"),
    ("policies", r"\b(policy|policies|terms|refund|cancel)\b"), ("onboarding", r"\b(onboard|getting started|implementation)\b"),
    ("support", r"\b(support|help desk)\b"), ("partnerships", r"\b(partner|affiliate)\b"), ("industries", r"\b(industries|sectors?)\b"),
    ("use_cases", r"\b(use cases?|solutions? for)\b"), ("technical", r"\b(technical|developers?|api|documentation)\b"),
    ("products", r"\b(products?|platform)\b"), ("services", r"\bservices?\b"), ("about", r"\b(about|our story|company|mission)\b"),
)
DECLARED = (*(name for name, _ in PAGE_TYPES), "home")

# Lanes by signals of heading, title and url, in order, and by page type.
LANES = (
    ("legal", r"\b(?:privacy|terms|policy|policies|refund|return|cancel|cookie|personal information|data collection|data retention|do not track|\bdnt\b)\b"),
    ("editorial", r"\b(?:blog|article|news|insight|resource|guide|tips?|best practices?|ways to|how to|what is|why |ideas? for|strategies? for)\b"),
    ("proof", r"\b(?:testimonial|review|case study|success stor|results?|customer stor|client stor|award|recognition)\b"),
    ("commercial", r"\b(?:services?|products?|pricing|packages?|plans?|offers?|menu|catalog|shop|store|solutions?|capabilities)\b"),
    ("market_customer", r"\b(?:industries?|who we serve|customers?|clients?|audience|markets?|use cases?|solutions? for|serving)\b"),
    ("operations", r"\b(?:faq|support|onboarding|getting started|implementation|training|help desk|process|contact|hours?)\b"),
    ("technical", r"\b(?:technical|developers?|api|sdk|webhook|integration|security|compliance|soc ?2|hipaa|gdpr|iso ?27001)\b"),
)
PAGE_LANES = {
    "products": "commercial", "services": "commercial", "pricing": "commercial", "industries": "market_customer", "use_cases": "market_customer",
    "locations": "market_customer", "case_studies": "proof", "testimonials": "proof", "certifications": "proof", "policies": "legal",
    "faq": "operations", "onboarding": "operations", "support": "operations", "contact": "operations", "technical": "technical",
    "integrations": "technical", "security": "technical", "compliance": "technical", "home": "core_business", "about": "core_business", "partnerships": "core_business",
}
PRICE = r"(?:[$£€]\s?\d|\b\d+(?:\.\d{2})\b|\b(?:price|pricing|per person|per item|per hour|per month|starting at|from only)\b)"
STRUCTURED = ("list_item", "table_row", "table_cell", "definition")

# Fact merging, conflicts and scores.
AGGREGATED = (
    "service", "product", "pricing_plan", "location_service_area", "certification", "integration", "industry_served", "primary_use_case",
    "support_onboarding", "customer_segment", "competitive_differentiator", "mission_value_proposition", "brand_voice_terminology",
)
PROOF = r"\b(?:testimonial|review|recommend|customer service|client|customer|user|case study|success story|results?|outcome|rating|stars?)\b"
GOOD_EVIDENCE = r"\b(?:special|offer|price|licensed|certified|serves?|specializes?|experience|results?|review|testimonial|case study|award|proprietary)\b"
BAD_EVIDENCE = r"\b(?:privacy policy|terms of use|cookie|personal information|advertiser|do not track|\bdnt\b)\b"
MATERIAL = r"(?:[$£€]\s?\d+(?:\.\d+)?|\d+\s?(?:days?|hours?|months?|years?|%|usd|gbp|eur)|[\w.+-]+@[\w.-]+\.[a-z]{2,})"
HEDGE = r"\b(?:may|might|typically|generally|approximately)\b"
RELEVANT_PAGES = {
    "pricing_plan": ("pricing",), "policy": ("policies", "support", "pricing"), "contact_information": ("contact", "support"),
    "service": ("services",), "product": ("products",), "integration": ("integrations",), "security_compliance": ("security", "compliance"),
    "certification": ("certifications",), "location_service_area": ("locations", "contact"),
}
COVERAGE = {
    "businessIdentity": ("business_identity", "company_overview"), "offers": ("product", "service", "pricing_plan"),
    "customers": ("customer_segment", "industry_served"), "pricing": ("pricing_plan",), "policies": ("policy", "security_compliance"),
    "processes": ("support_onboarding",), "faq": ("faq",), "contact": ("contact_information", "location_service_area"),
    "companyOverview": ("company_overview", "business_identity"), "missionValueProposition": ("mission_value_proposition",),
    "products": ("product",), "services": ("service",), "featuresCapabilities": ("feature_capability",), "pricingPlans": ("pricing_plan",),
    "customerSegments": ("customer_segment",), "industriesServed": ("industry_served",), "primaryUseCases": ("primary_use_case",),
    "integrations": ("integration",), "aiFeaturesAutomation": ("ai_automation",), "technicalCapabilities": ("technical_capability",),
    "securityCompliance": ("security_compliance",), "certifications": ("certification",), "supportOnboarding": ("support_onboarding",),
    "partnerships": ("partnership",), "locationsServiceAreas": ("location_service_area",), "contactInformation": ("contact_information",),
    "brandVoiceTerminology": ("brand_voice_terminology",), "frequentlyAskedQuestions": ("faq",),
    "competitiveDifferentiators": ("competitive_differentiator",), "additionalBusinessKnowledge": ("additional_business_knowledge",),
}
CORE_FIELDS = ("businessIdentity", "offers", "customers", "contact")

# Topics that several wordings share, by category.
TOPIC_ALIASES = (
    ("security_compliance", "soc2", r"\bsoc\s*(?:ii|2)\b"), ("security_compliance", "hipaa", r"\bhipaa\b"), ("security_compliance", "iso_27001", r"\biso\s*27001\b"),
    ("security_compliance", "gdpr", r"\bgdpr\b"), ("security_compliance", "encryption", r"\bencrypt(?:ed|ion)?\b"), ("security_compliance", "sso", r"\bsso\b"),
    ("security_compliance", "mfa", r"\bmfa\b"), ("integration", "google_workspace", r"\bgoogle\s+(?:workspace|apps)\b"), ("service", "google_ads", r"\bgoogle\s+ads?\b"),
    ("service", "seo", r"\bseo\b|\bsearch engine optimi[sz]ation\b"),
)
TOPIC_SPACES = {"contact_information": "contact", "location_service_area": "location", "industry_served": "industry"}
GENERIC_HEADINGS = r"^(?:what we (?:offer|do|help with)|our solutions|solutions (?:for|built for) growth|our expertise|popular services|featured products|products? and services?|services?|products?|industries|who we serve|locations?|where we work|capabilities)$"
NAME_NOISE = r"^(?:(?:our|choose|select|try|use)\s+(?:the\s+)?|the\s+)"
OFFER_WORDS = "special|offer|promotion|plan|package|tier|subscription"
WORK_WORDS = "implementation|consulting|training|management|design|optimization|cleaning|strategy|development|marketing|support|maintenance"
TOOL_WORDS = "product|platform|software|app|application|suite|tool"
EMAIL = r"[\w.+-]+@[\w.-]+\.[a-z]{2,}"
PHONE = r"\+?\d[\d ().-]{7,}\d"
# Patterns of an item's own name in its sentence, by category, the first that gives a name wins.
NAMED = {
    "pricing_plan": (
        rf"\b([a-z0-9][a-z0-9 '&.-]*?)\s+(?:{OFFER_WORDS})\b",
        rf"\b(?:{OFFER_WORDS})\s+(?:for\s+)?([a-z0-9][a-z0-9 '&.-]*?)(?:[.,]|$)",
    ),
    "product": (rf"\b(?:our\s+)?([a-z0-9][a-z0-9 '&.-]*?)\s+(?:{TOOL_WORDS})\b",),
    "service": (
        rf"^({WORK_WORDS})$",
        r"\b(?:we\s+(?:offer|provide|deliver)|our services? include|(?:our\s+)?(?:business|company|agency|firm|practice|studio|team)\s+specializes? in)\s+(.+?)(?:[.;]|\s+for\b|$)",
        rf"^(.+?(?:{WORK_WORDS}|service|services))$",
    ),
    "primary_use_case": (r"\b(?:helps?|used (?:to|for)|designed to|built to|enables?|solves?|supports?)\s+(.+?)(?:[.;]|$)",),
    "industry_served": (r"\b(?:solutions? for|serving (?:the\s+)?|industries? (?:we )?serve\s*:?|teams? in)\s+(.+?)(?:\s+(?:organizations?|companies|businesses|industry|sector))?(?:[.,]|$)",),
    "location_service_area": (r"\b(?:(?:located|based|office(?: is)? located)\s+in|serve|serving|available throughout|available in)\s+(.+?)(?:[.,]|\s+and\b|$)",),
}
BARE_ITEM = r"^(?:software|product|platform|app|application|suite|tool|service|services)$"
BARE_PLACE = r"^(?:[A-Z][a-z]+(?:[ -][A-Z][a-z]+){0,3})$"
POLICY_NAME = r"\b(refund|return|cancellation?|privacy|warranty|guarantee|terms|retention)\b"
