"""The shipped rule facts, as plain tables.

Everything below is a fixed value: field names, severities, labels and legal
texts decide the printed results, so they are stated as they must appear.
Advisory checks (rules without a condition) never produce a violation and are
therefore not listed.
"""

ACT = "Legal Metrology (Packaged Commodities) Rules, 2011 — Rule "

LEGAL_TEXTS = {
    "manufacturer": (
        ACT + "6(1)(a)",
        "The package must declare the name and address of the manufacturer "
        "and, where applicable, the packer or importer.",
    ),
    "generic_name": (
        ACT + "6(1)(b)",
        "The package must state the common or generic name of the commodity "
        "so that the nature of the product is clearly identifiable.",
    ),
    "net_quantity": (
        ACT + "6(1)(c)",
        "The package must declare the net quantity of the commodity in the "
        "prescribed unit of weight, measure or number.",
    ),
    "mrp": (
        ACT + "6(1)(e)",
        "The package must declare the maximum retail price in the prescribed "
        "manner, including applicable tax requirements.",
    ),
    "consumer_care": (
        ACT + "6(1)(f)",
        "The package must provide the prescribed details for consumers to "
        "contact the manufacturer, packer or importer regarding complaints.",
    ),
    "country_of_origin": (
        ACT + "6(1)(aa)",
        "For imported products, the package must declare the country of "
        "origin, manufacture or assembly.",
    ),
}

# Required on every package unless a category exempts the field.
BASE_MANDATORY = {
    "manufacturer": ("high", "Name & Address of Manufacturer/Packer/Importer"),
    "generic_name": ("high", "Common / Generic Name of Commodity"),
    "net_quantity": ("high", "Net Quantity"),
    "mrp": ("high", "Maximum Retail Price (MRP)"),
    "consumer_care": ("high", "Consumer Care Details"),
}

MRP_LABEL = "Maximum Retail Price (inclusive of all taxes)"
PACKER_LABEL = "Name and Address of Manufacturer / Packer / Importer"


def _fields(**labels):
    """field -> label, or (severity, label) where it is not high."""
    out = {}
    for field, label in labels.items():
        severity, text = label if isinstance(label, tuple) else ("high", label)
        out[field] = {"severity": severity, "label": text}
    return out


CATEGORIES = [
    {
        "product_type": "general",
        "mandatory": _fields(
            manufacturer=PACKER_LABEL,
            generic_name="Common or Generic Name of the Commodity",
            net_quantity="Net Quantity",
            mrp=MRP_LABEL,
            consumer_care="Consumer Care Details (including email)",
        ),
    },
    {
        "product_type": "food",
        "mandatory": _fields(
            manufacturer=PACKER_LABEL,
            generic_name="Name of the Food",
            net_quantity="Net Quantity",
            mrp=MRP_LABEL,
            consumer_care="Consumer Care Details",
        ),
        "exempted": ["mfg_date"],
    },
    {
        "product_type": "cosmetics",
        "mandatory": _fields(
            manufacturer="Name and Address of Manufacturer / Packer",
            generic_name="Name of the Cosmetic Product",
            net_quantity="Net Quantity",
            mrp=MRP_LABEL,
            consumer_care="Consumer Care Details",
        ),
        "exempted": ["mfg_date"],
    },
    {
        "product_type": "electronic",
        "mandatory": _fields(
            manufacturer="Name of Manufacturer / Packer / Importer "
            "(full address may be via QR)",
            generic_name=(
                "medium",
                "Common / Generic Name (may be provided via QR code with "
                "instruction on package)",
            ),
            net_quantity="Net Quantity / Number of units",
            mrp=MRP_LABEL,
            consumer_care="Consumer Care Details",
        ),
    },
    {
        "product_type": "garments",
        "mandatory": _fields(
            manufacturer="Name and Address of Manufacturer / Brand Owner / Importer",
            country_of_origin="Country of Origin (for imported garments)",
            mrp=MRP_LABEL,
            consumer_care=("medium", "Consumer Care number / email"),
        ),
        "exempted": ["generic_name", "net_quantity", "unit_sale_price",
                     "mfg_date", "best_before"],
    },
    {
        "product_type": "imported",
        "mandatory": _fields(
            manufacturer="Name and Address of Importer",
            country_of_origin="Country of Origin / Manufacture / Assembly",
            generic_name="Common or Generic Name",
            net_quantity="Net Quantity",
            mrp=MRP_LABEL,
            consumer_care="Consumer Care Details",
        ),
        "custom_checks": [
            {
                "rule_id": "IMP_001",
                "field": "country_of_origin",
                "must_exist": True,
                "severity": "high",
                "message": "Country of Origin is mandatory for all imported packages",
                "suggestion": "Declare clearly as 'Country of Origin: XXX' or 'Made in XXX'",
            }
        ],
    },
    {
        "product_type": "alcohol",
        "mandatory": _fields(
            manufacturer="Name and Address of Manufacturer / Bottler",
            generic_name="Type of Alcoholic Beverage",
            net_quantity="Net Quantity (volume)",
            mrp="Maximum Retail Price (as per State Excise rules)",
        ),
        "exempted": ["unit_sale_price"],
    },
    {
        "product_type": "drugs_medical",
        "mandatory": _fields(
            manufacturer="Name and Address of Manufacturer",
            generic_name="Name of the Drug / Device",
            net_quantity=("medium", "Net Quantity / Pack size"),
            mrp=MRP_LABEL + " – where applicable",
        ),
        "exempted": ["unit_sale_price", "best_before"],
    },
    {
        "product_type": "ecommerce",
        "mandatory": _fields(
            manufacturer=PACKER_LABEL,
            generic_name="Common or Generic Name",
            net_quantity="Net Quantity",
            mrp=MRP_LABEL,
            consumer_care="Consumer Care Details",
            country_of_origin="Country of Origin (if imported)",
        ),
        "exempted": ["mfg_date", "unit_sale_price"],
    },
    {
        "product_type": "multi_piece",
        "mandatory": _fields(
            manufacturer=PACKER_LABEL,
            generic_name="Identity of commodity + number of retail packages / pieces",
            net_quantity="Total net quantity or number of retail packages",
            mrp="Maximum Retail Price of the multi-piece package (inclusive of all taxes)",
        ),
        "exempted": ["unit_sale_price"],
    },
    {
        "product_type": "seeds",
        "mandatory": _fields(
            manufacturer="Name and Address",
            generic_name="Kind / Variety of Seed",
            net_quantity="Net Quantity",
            mrp=MRP_LABEL,
        ),
        "exempted": ["mfg_date"],
    },
    {
        "product_type": "wholesale",
        "mandatory": _fields(
            manufacturer=PACKER_LABEL,
            generic_name="Identity of the commodity",
            net_quantity="Total number of retail packages OR net quantity",
        ),
        "exempted": ["mrp", "unit_sale_price", "consumer_care",
                     "best_before", "mfg_date"],
    },
]

PRODUCT_NAMES = {
    "food": """baby_food biscuits breakfast_cereals carbonated_beverages coffee
        edible_oils fruit_juices honey instant_noodles jams_spreads milk
        packaged_drinking_water packaged_salt packaged_snacks spices_masala tea""",
    "cosmetics": """body_lotion conditioner deodorant face_cream face_wash
        foundation hair_oil handwash lipstick makeup_products mouthwash perfume
        shampoo soap sunscreen talcum_powder toothbrush toothpaste""",
    "electronic": """batteries earphones led_bulbs mobile_chargers mobile_phone
        power_banks""",
    "general": """adult_hygiene baby_diapers baby_wipes detergent_powder
        dishwashing_liquid disinfectant floor_cleaner garbage_bags
        liquid_detergent sanitary_napkins toilet_cleaner""",
}

EXTRA_MANDATORY = {
    "baby_food": [
        ("best_before", "high", "Best Before / Use By date is critical"),
        ("mfg_date", "high", "Manufacturing date is mandatory"),
    ],
    "packaged_drinking_water": [
        ("best_before", "high", "Best Before date is mandatory"),
        ("mfg_date", "high", "Date of packaging / manufacturing"),
    ],
    "milk": [("best_before", "high", "Best Before / Use By is mandatory")],
    "edible_oils": [("best_before", "high", "Best Before date recommended")],
    "sunscreen": [("best_before", "medium", "Best Before date recommended")],
}

PRODUCTS = [
    {
        "product": name,
        "category": category,
        "extra_mandatory": [
            {"field": f, "severity": s, "label": label}
            for f, s, label in EXTRA_MANDATORY.get(name, [])
        ],
    }
    for category, names in PRODUCT_NAMES.items()
    for name in names.split()
]
