"""Word lists of the message rules, in their order of precedence."""

from __future__ import annotations

# Devanagari words that mark Marathi (other Devanagari text is Hindi).
MARATHI_MARKERS = [
    "आहेत", "झाली", "कशी", "कोणते", "मला", "का", "आहे", "होईल", "करावे", "साठा", "मागणी", "कुठे",
    "सुधारणा", "पैसे", "वाचवता", "खर्च", "कसा",
]
# Marathi words in Latin script.
MARATHI_LATIN = [
    "mala", "konte", "karayche", "aahet", "jhali", "zali", "kashi", "kuthun", "aala", "magni", "kasa", "kute",
    "sudharna", "vachavta",
]
# Hindi words in Latin script.
HINGLISH = [
    "kaunsa", "konsa", "sabse", "zyada", "jyada", "mujhe", "chahiye", "kyu", "kyun", "hogi", "badh", "rahi", "raha",
    "hai", "kya", "scene", "kare", "kitni", "kitna", "kahan", "karo", "kisko", "paisa", "paise", "kamai", "bikri",
    "khatam", "batao", "chal", "kaisa", "lagengi", "lagenge", "padega", "bacha", "bachaye", "fayda", "agale", "agle",
    "hafte", "kharidna", "order", "iska", "uski", "dhyan",
]

# Short intent table: first intent with a contained phrase wins.
INTENTS = {
    "STOCKOUT_INVENTORY": ["stockout", "risk", "out of stock", "low stock", "safety stock", "reorder", "inventory"],
    "ANOMALY_ALERTS": ["anomaly", "anomalies", "spike", "drop", "surge", "irregular", "outlier"],
    "FORECAST_INQUIRY": ["forecast", "predict", "next week", "future demand", "expected"],
    "SALES_REVENUE": [
        "top moving", "fast moving", "best seller", "revenue", "gmv", "growth", "wow", "mom", "sales",
    ],
    "PRODUCT_SEARCH": ["product", "sku", "catalog", "price", "mrp", "pack"],
}
DEFAULT_INTENT = "GENERAL_INTELLIGENCE"

# Long intent table.
BUSINESS_INTENTS = {
    "unsupported": [
        "six months from now", "6 months from now", "next year", "market price", "stock market", "share price",
        "crypto", "competitor sales", "inflation rate in 2025", "weather forecast next month", "festival caused",
        "typhoon caused",
    ],
    "why_inquiry": ["why", "kyu", "kyun", "का"],
    "cost": [
        "how much will it cost", "how much will that order cost", "how much will this order cost",
        "how much money do i need", "procurement cost", "purchase cost", "restocking cost", "order cost",
        "is this order expensive", "cost kya hogi", "kitne paise lagenge", "iska cost", "iska order kitne ka",
        "order karne ke liye kitne paise", "kitne paise chahiye", "हा order किती रुपयांचा", "खर्च किती",
        "खर्च किती येईल", "cost kitna", "cost kitni", "how much cost",
    ],
    "cost_saving": [
        "how can we save money", "save money", "where are we spending too much", "save money on inventory",
        "how much can we save", "where is money tied up", "reducing overstock save money", "cost saving",
        "cost savings", "reduce cost", "paise kaha save", "paise bacha", "paise bachaye", "money tied up",
        "capital tied up", "कुठे पैसे वाचवता येतील", "पैसे कसे वाचवायचे", "बचत",
    ],
    "action_focus": [
        "where should i focus", "what should i focus on", "what should i do", "what needs attention",
        "where should i take action", "priority", "what to do", "action item", "kaha dhyan du", "kya karna chahiye",
        "kahan focus karu", "कुठे सुधारणा हवी", "काय करावे", "कशावर लक्ष द्यावे",
    ],
    "inventory_health": [
        "healthy inventory", "inventory health", "maintaining healthy inventory", "is my inventory healthy",
        "inventory healthy hai kya", "inventory ka kya scene", "stockout risk", "overstock risk",
        "where am i overstocked", "where do i have stockout", "माझी inventory healthy आहे का",
        "inventory ची स्थिती कशी आहे", "स्टॉकची स्थिती", "stockout", "overstock", "causing the problem",
    ],
    "inventory": [
        "restock", "reorder", "replenish", "what should i order", "which products should i restock",
        "how many should i order", "why should i order this", "do i need to reorder", "order quantity",
        "mujhe kya order karna chahiye", "next week kya order karu", "agale hafte kitna order",
        "पुढच्या आठवड्यात किती order", "मला कोणते products restock करायचे आहेत", "साठा", "माल",
        "order karna chahiye kya", "isko order karna chahiye",
    ],
    "business_health": [
        "how is my business doing", "overall business health", "business health", "are sales healthy",
        "are we growing", "what should i be worried about", "what's happening with my business",
        "whats happening with my business", "business ka kya scene", "business kaisa chal raha hai",
        "business kaisa chal raha", "माझा business कसा चालला आहे", "व्यवसाय कसा चालला आहे",
    ],
    "change_detection": [
        "what changed", "what changed this week", "what is different from last week", "what's new",
        "business mein kya change hua", "kya badla", "change this week", "difference from last week",
        "recent change", "काय बदल झाले",
    ],
    "margin": ["margin", "margins"],
    "profit": [
        "profit", "profitable", "how much profit", "which products are profitable",
        "which product has highest profit", "profit margin", "profit kaha se", "kaunsa product profitable",
        "नफा", "फायदा",
    ],
    "trends": [
        "trend", "trends", "is demand increasing or falling", "which products are declining",
        "which cities are growing", "revenue trend", "demand badh rahi ya kam", "रुझान", "ट्रेंड",
    ],
    "anomaly": [
        "anomaly", "anomalies", "spike", "drop", "unusual", "outlier", "alert", "flagged",
        "why did demand drop", "gadbad", "ajeeb", "विसंगती", "तफावत",
    ],
    "forecast": [
        "forecast", "predict", "predicted", "prediction", "next week", "next month", "expected demand", "projected",
        "demand kitni hogi", "hogi", "अंदाज", "होईल", "आगामी मांग", "पुढील आठवडा", "भविष्यातील मागणी",
    ],
    "city_performance": [
        "which city", "delhi doing", "in mumbai", "in delhi", "in bengaluru", "in hr-ncr", "city performance",
        "delhi ka kya scene", "delhi ka performance", "mumbai ka performance",
    ],
    "product_performance": [
        "which products perform best", "generate the most revenue", "highest revenue", "sell the most", "top selling",
        "best performing", "sabse zyada bik raha", "sabse zyada revenue", "top products", "most revenue",
        "सर्वोत्तम उत्पादने",
    ],
    "data": [
        "what data", "which data", "data did you use", "source data", "kahan se data", "dataset used",
        "database used", "source kya",
    ],
}
DEFAULT_BUSINESS_INTENT = "demand"
# A message that is nothing but a request for the reason.
BARE_WHY = r"^\s*(why\??|why so\??|kyu\??|kyun\??|का\??|why is that\??)\s*$"

# Words of a message that refers to an earlier one.
FOLLOW_UPS = [
    "it", "this", "that", "this product", "that product", "them", "these", "iska", "isko", "iski", "uska", "usko",
    "uski", "inka", "inko", "how much", "how much will it cost", "how much does it cost", "kitne paise",
    "kitne lagenge", "cost kitna", "cost kitni", "kitna padega", "paise lagenge", "why", "why?", "kyu", "kyun", "kyu?",
    "kyun?", "का", "का?", "what about", "and in", "same for", "for delhi", "in that city", "there",
    "where should i focus", "what should i do", "which products are causing the problem", "can we save money",
    "why should i order this", "order karna chahiye kya", "हा order", "खर्च किती", "कुठे सुधारणा",
]

# City synonyms of the two message forms.
HUBS = {
    "delhi": "Delhi", "bengaluru": "Bengaluru", "bangalore": "Bengaluru", "mumbai": "Mumbai", "hr-ncr": "HR-NCR",
    "gurgaon": "HR-NCR",
}
CITY_SYNONYMS = {
    "delhi": "Delhi", "दिल्ली": "Delhi", "mumbai": "Mumbai", "मुंबई": "Mumbai", "bombay": "Mumbai",
    "bengaluru": "Bengaluru", "bangalore": "Bengaluru", "बेंगलुरु": "Bengaluru", "बंगळूर": "Bengaluru",
    "hr-ncr": "HR-NCR", "ncr": "HR-NCR", "gurgaon": "HR-NCR", "gurugram": "HR-NCR", "faridabad": "HR-NCR",
}
