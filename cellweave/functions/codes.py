"""Class names, remap tables, decades, colours and area factors.

All of these must equal the published tables for results to match.
"""

# Class names of the detailed schema.
DETAILED = {
    0: "Unclassified",
    11: "Open Water",
    21: "Developed, Open Space",
    22: "Developed, Low Intensity",
    23: "Developed, Medium Intensity",
    24: "Developed, High Intensity",
    31: "Barren, Natural",
    32: "Barren, Anthropogenic",
    41: "Deciduous Forest",
    42: "Evergreen Forest",
    43: "Mixed Forest",
    52: "Shrub/Scrub",
    56: "Shrub/Scrub successional",
    71: "Herbaceous",
    75: "Harvested/Disturbed",
    81: "Hay/Pasture",
    82: "Cultivated Crops",
    90: "Woody Wetlands",
    95: "Emergent Herbaceous Wetlands",
}

# Class names of the general schema.
GENERAL = {
    0: "Undefined",
    1: "Open Water",
    2: "Developed",
    3: "Agriculture",
    4: "Natural",
    5: "Successional",
    6: "Harvested/Disturbed",
}

# Detailed code to general code (None is NoData).
TO_GENERAL = {
    0: None, 11: 1, 21: 2, 22: 2, 23: 2, 24: 2, 31: 4, 32: 2, 41: 4, 42: 4, 43: 4,
    52: 5, 56: 5, 71: 5, 75: 6, 81: 3, 82: 3, 90: 4, 95: 4,
}

# Likeliest kind of barren by the 1992 code of the cell.
BARREN_FROM_1992 = {
    0: None, 11: 31, 21: 32, 22: 32, 23: 32, 31: 31, 32: 32, 33: 32, 41: 32, 42: 32,
    43: 32, 51: 32, 61: 32, 71: 32, 81: 32, 82: 32, 83: 32, 84: 32, 85: 32, 91: 31, 92: 31,
}

# Likeliest kind of barren by the standard code of the cell.
BARREN_FROM_STANDARD = {
    0: None, 11: 31, 21: 32, 22: 32, 23: 32, 24: 32, 31: 31, 32: 32, 41: 32, 42: 32,
    43: 32, 52: 32, 71: 32, 81: 32, 82: 32, 90: 31, 95: 31,
}

# Codes an indicator layer knows, and its non-zero values.
INDICATOR_CODES = [11, 12, 21, 22, 23, 24, 31, 41, 42, 43, 52, 71, 81, 82, 90, 95]
INDICATORS = {
    "wet": {90: 1, 95: 1},
    "opn": {31: 1, 71: 1, 81: 1, 82: 1},
    "wat": {11: 1},
    "shb": {52: 1},
    "dfr": {41: 100, 43: 50},
    "efr": {42: 100, 43: 50},
}
# Layers whose values run to 100; the others run to 1.
PERCENT_LAYERS = ["impsur", "canopy", "dfr", "efr"]

# NoData sentinels.
CLASS_NODATA, IMPERVIOUS_NODATA, CANOPY_NODATA = 0, 127, 255

# Forest and developed classes of the change summary.
FOREST = [41, 42, 43, 52, 90]
DEVELOPED = [21, 22, 23, 24, 32]

# Labels of the change summary, {a} and {b} the start and end class.
SUMMARY_LABELS = {
    0: "not {a} in either time period",
    1: "{a} in both time periods",
    2: "{a} to {b}",
    3: "{a} to non-{b} class",
    4: "{b} to {a}",
    5: "non-{b} class to {a}",
}
# Code 4 where changes towards the start class are not told apart.
SUMMARY_LABEL_4_FORWARD = "non-{a} class to {a}"

# Change types of moves to and from a class {a}.
NO_CHANGE = "No change"
STAYED_IN, STAYED_OUT = "{a} both time periods", "Not {a} either time period"

# Groups of periods.
FULL_PERIOD, OTHER_PERIODS = "Full period", " Intermediate periods"

# Decade code to name, in display order. 99 is the class studied.
DECADES = {
    20: "Developed",
    80: "Agriculture",
    30: "Barren",
    40: "Forest",
    50: "Shrub/Scrub",
    60: "Successional",
    70: "Herbaceous",
    90: "Wetlands",
    10: "Water",
}

# Line colours of the general classes.
GENERAL_COLOURS = {
    "Natural": "DarkGreen",
    "Agriculture": "GoldenRod",
    "Developed": "DarkRed",
    "Open Water": "Blue",
    "Successional": "LimeGreen",
    "Harvested/Disturbed": "lightcyan4",
}

# Bar colours of the decade classes.
DECADE_COLOURS = {
    "Forest": "DarkGreen",
    "Agriculture": "gold3",
    "Developed": "purple",
    "Water": "skyblue1",
    "Barren": "grey70",
    "Shrub/Scrub": "darkseagreen4",
    "Successional": "lightgreen",
    "Herbaceous": "yellowgreen",
    "Wetlands": "aquamarine4",
}

# One 30 m cell in hectares and acres.
CELL_HA, CELL_AC = 0.09, 0.2223948429

# Years of the series and the periods compared.
YEARS = [2001, 2004, 2006, 2008, 2011, 2013, 2016, 2019, 2021]
PERIODS = [(2001, 2021), (2001, 2011), (2011, 2021)]
