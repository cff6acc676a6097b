"""Value lists and constants the workloads are defined by.

FIXED VALUES: results depend on these exact words and numbers, in this order.
"""

SHIP_MODES = ["REG AIR", "AIR", "RAIL", "SHIP", "TRUCK", "MAIL", "FOB"]
SHIP_INSTRUCTS = ["DELIVER IN PERSON", "COLLECT COD", "NONE", "TAKE BACK RETURN"]
RETURN_FLAGS = ["A", "R", "N"]
LINE_STATUS = ["O", "F"]
ORDER_STATUS = ["O", "F", "P"]
ORDER_PRIORITIES = ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"]
URGENT_PRIORITIES = ["1-URGENT", "2-HIGH"]
Q7_NATIONS = ["FRANCE", "GERMANY"]
Q12_MODES = ["MAIL", "SHIP"]
Q16_SIZES = [49, 14, 23, 45, 19, 3, 36, 9]
SEGMENTS = ["AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY"]
REGIONS = ["AFRICA", "AMERICA", "ASIA", "EUROPE", "MIDDLE EAST"]
NATIONS = [
    "ALGERIA", "ARGENTINA", "BRAZIL", "CANADA", "EGYPT",
    "ETHIOPIA", "FRANCE", "GERMANY", "INDIA", "INDONESIA",
    "IRAN", "IRAQ", "JAPAN", "JORDAN", "KENYA",
    "MOROCCO", "MOZAMBIQUE", "PERU", "CHINA", "ROMANIA",
    "SAUDI ARABIA", "VIETNAM", "RUSSIA", "UNITED KINGDOM", "UNITED STATES",
]
BRANDS = [f"Brand#{maker}{line}" for maker in range(1, 6) for line in range(1, 6)]
CONTAINERS = [
    f"{size} {kind}"
    for size in ("SM", "MED", "LG", "WRAP", "JUMBO")
    for kind in ("CASE", "BOX", "PACK", "PKG", "BAG", "JAR", "CAN", "DRUM")
]
PART_TYPES = [
    "ECONOMY ANODIZED STEEL", "ECONOMY BURNISHED COPPER",
    "ECONOMY PLATED STEEL", "ECONOMY BRUSHED TIN",
    "PROMO ANODIZED TIN", "PROMO BURNISHED STEEL",
    "PROMO PLATED NICKEL", "PROMO BRUSHED TIN",
    "STANDARD POLISHED BRASS", "STANDARD ANODIZED BRASS",
    "STANDARD BURNISHED COPPER", "STANDARD PLATED STEEL",
    "SMALL BRUSHED NICKEL", "SMALL PLATED TIN",
    "SMALL ANODIZED STEEL", "SMALL BURNISHED BRASS",
    "LARGE BURNISHED COPPER", "LARGE POLISHED NICKEL",
    "LARGE ANODIZED STEEL", "LARGE PLATED BRASS",
    "MEDIUM POLISHED COPPER", "MEDIUM BRUSHED TIN",
    "MEDIUM ANODIZED BRASS", "MEDIUM PLATED STEEL",
]
# The promotion query (Q14) cycles through its own, shorter list.
PROMO_QUERY_TYPES = [
    "ECONOMY ANODIZED STEEL", "ECONOMY BURNISHED COPPER",
    "PROMO ANODIZED TIN", "PROMO BURNISHED STEEL",
    "PROMO PLATED NICKEL", "STANDARD POLISHED BRASS",
    "SMALL BRUSHED NICKEL", "LARGE BURNISHED COPPER",
    "ECONOMY PLATED STEEL", "PROMO BRUSHED TIN",
    "STANDARD ANODIZED BRASS", "MEDIUM POLISHED COPPER",
]
PART_COLORS = [
    "almond", "antique", "aquamarine", "azure", "beige",
    "bisque", "black", "blanched", "blue", "blush",
    "brown", "burlywood", "burnished", "chartreuse", "chiffon",
    "chocolate", "coral", "cornflower", "cornsilk", "cream",
    "cyan", "dark", "deep", "dim", "dodger",
    "drab", "firebrick", "floral", "forest", "frosted",
    "gainsboro", "ghost", "goldenrod", "green", "grey",
    "honeydew", "hot", "indian", "ivory", "khaki",
    "lace", "lavender", "lawn", "lemon", "light",
    "lime", "linen", "magenta", "maroon", "medium",
    "metallic", "midnight", "mint", "misty", "moccasin",
    "navajo", "navy", "olive", "orange", "orchid",
    "pale", "papaya", "peach", "peru", "pink",
    "plum", "powder", "puff", "purple", "red",
    "rose", "rosy", "royal", "saddle", "salmon",
    "sandy", "seashell", "sienna", "sky", "slate",
    "smoke", "snow", "spring", "steel", "tan",
    "thistle", "tomato", "turquoise", "violet", "wheat",
    "white", "yellow",
]
ORDER_COMMENTS = [
    "regular accounts are carefully",
    "special requests about the slyly pending",
    "pending deposits boost carefully special requests",
    "furiously special ideas haggle blithely",
    "ironic foxes detect slyly regular courts",
    "blithely final accounts use evenly",
    "quickly express asymptotes are about the special requests",
    "final deposits cajole carefully special packages",
]
# Country codes looked for by Q22, then the ones it ignores.
SALES_CODES = ["13", "31", "23", "29", "30", "18", "17"]
OTHER_CODES = ["10", "11", "12", "14", "15", "16", "19", "20"]
US_STATES = [
    "OR", "ID", "CA", "WA", "NY", "TX", "FL", "IL", "PA", "OH",
    "GA", "NC", "MI", "NJ", "VA", "AZ", "MA", "TN", "IN", "MO",
    "MD", "WI", "CO", "MN", "SC", "AL", "LA", "KY", "OK", "CT",
    "UT", "IA", "NV", "AR", "MS", "KS", "NM", "NE", "WV", "HI",
    "NH", "ME", "MT", "RI", "DE", "SD", "ND", "AK", "VT", "WY",
]

# Abramowitz and Stegun 7.1.26, error function, |error| < 1.5e-7.
ERF_P = 0.3275911
ERF_A = [0.254829592, -0.284496736, 1.421413741, -1.453152027, 1.061405429]

# Epoch days. The generated calendar starts 1992-01-01 and wraps after seven years.
CALENDAR_START = 8035
CALENDAR_DAYS = 2556
DAY_1993_07_01 = 8582
DAY_1993_10_01 = 8674
DAY_1994_01_01 = 8766
DAY_1995_01_01 = 9131
DAY_1995_03_15 = 9204
DAY_1995_09_01 = 9374
DAY_1995_10_01 = 9404
DAY_1996_12_31 = 9861
DAY_1998_09_02 = 10471
# Q15's quarter as the workload defines it: one day after the calendar quarter.
Q15_FROM_DAY = 9497
Q15_TO_DAY = 9588
# Years in the row kernels are 1970 + days // 365 (no leap days).
KERNEL_YEAR_DAYS = 365
