"""Fixed values that results depend on: residue scales, units, species and the strain panel."""

from __future__ import annotations

AMINO_ACIDS = "ACDEFGHIKLMNPQRSTVWY"
MIN_LENGTH, MAX_LENGTH, MAX_CYSTEINES, MOMENT_CEILING, WATER = 8, 50, 2, 2.6, 18.0153

HYDROPATHY = {
    "A": 1.8, "C": 2.5, "D": -3.5, "E": -3.5, "F": 2.8, "G": -0.4, "H": -3.2, "I": 4.5, "K": -3.9, "L": 3.8,
    "M": 1.9, "N": -3.5, "P": -1.6, "Q": -3.5, "R": -4.5, "S": -0.8, "T": -0.7, "V": 4.2, "W": -0.9, "Y": -1.3,
}
EISENBERG = {
    "A": 0.62, "C": 0.29, "D": -0.90, "E": -0.74, "F": 1.19, "G": 0.48, "H": -0.40, "I": 1.38, "K": -1.50, "L": 1.06,
    "M": 0.64, "N": -0.78, "P": 0.12, "Q": -0.85, "R": -2.53, "S": -0.18, "T": -0.05, "V": 1.08, "W": 0.81, "Y": 0.26,
}
MASS = {
    "A": 71.0788, "C": 103.1388, "D": 115.0886, "E": 129.1155, "F": 147.1766, "G": 57.0519, "H": 137.1411, "I": 113.1594, "K": 128.1741, "L": 113.1594,
    "M": 131.1926, "N": 114.1038, "P": 97.1167, "Q": 128.1307, "R": 156.1875, "S": 87.0782, "T": 101.1051, "V": 99.1326, "W": 186.2132, "Y": 163.1760,
}
FITNESS_H = {
    "A": 0.25, "C": 0.04, "D": -0.72, "E": -0.62, "F": 0.61, "G": 0.16, "H": -0.40, "I": 0.73, "K": -1.10, "L": 0.53,
    "M": 0.26, "N": -0.64, "P": -0.07, "Q": -0.69, "R": -1.80, "S": -0.26, "T": -0.18, "V": 0.54, "W": 0.37, "Y": 0.02,
}
FITNESS_HX = {
    "A": 0.00, "C": 0.68, "D": 0.69, "E": 0.40, "F": 0.54, "G": 1.00, "H": 0.61, "I": 0.41, "K": 0.26, "L": 0.21,
    "M": 0.24, "N": 0.65, "P": 3.16, "Q": 0.39, "R": 0.21, "S": 0.50, "T": 0.66, "V": 0.61, "W": 0.49, "Y": 0.53,
}
CHARGE = {"K": 1.0, "R": 1.0, "H": 0.1, "D": -1.0, "E": -1.0}

LOG_LOW, LOG_SPAN = -1.0, 4.0
MOLAR_UNITS = {"m": 1e6, "mm": 1e3, "um": 1.0, "nm": 1e-3, "pm": 1e-6, "mol/l": 1e6, "mmol/l": 1e3, "umol/l": 1.0, "nmol/l": 1e-3}
MASS_UNITS = {"ug/ml": 1.0, "mcg/ml": 1.0, "mg/l": 1.0, "ug/l": 1e-3, "mg/ml": 1e3, "g/l": 1e3, "ng/ml": 1e-3, "ng/ul": 1.0}

GRAM_INDEX = {"unknown": 0, "negative": 1, "positive": 2, "fungal": 3, "mycobacterial": 4}
GRAM_GENERA = {
    "negative": "escherichia pseudomonas klebsiella acinetobacter salmonella shigella enterobacter serratia proteus burkholderia stenotrophomonas haemophilus neisseria helicobacter campylobacter vibrio yersinia citrobacter moraxella legionella bordetella brucella francisella",
    "positive": "staphylococcus streptococcus enterococcus bacillus listeria clostridium clostridioides corynebacterium micrococcus lactobacillus lactococcus cutibacterium propionibacterium nocardia",
    "mycobacterial": "mycobacterium mycobacteroides mycolicibacterium",
    "fungal": "candida cryptococcus aspergillus saccharomyces fusarium trichophyton malassezia",
}
#: Genus by initial and epithet.
ABBREVIATED = {
    "a baumannii": "acinetobacter", "a faecalis": "alcaligenes", "b subtilis": "bacillus", "b cereus": "bacillus", "b anthracis": "bacillus",
    "c albicans": "candida", "c difficile": "clostridioides", "c perfringens": "clostridium", "e coli": "escherichia", "e faecalis": "enterococcus",
    "e faecium": "enterococcus", "e cloacae": "enterobacter", "h influenzae": "haemophilus", "h pylori": "helicobacter", "k pneumoniae": "klebsiella",
    "l monocytogenes": "listeria", "m luteus": "micrococcus", "m tuberculosis": "mycobacterium", "m smegmatis": "mycobacterium", "n gonorrhoeae": "neisseria",
    "n meningitidis": "neisseria", "p aeruginosa": "pseudomonas", "p mirabilis": "proteus", "p vulgaris": "proteus", "s aureus": "staphylococcus",
    "s epidermidis": "staphylococcus", "s pyogenes": "streptococcus", "s pneumoniae": "streptococcus", "s agalactiae": "streptococcus", "s typhimurium": "salmonella",
    "s enterica": "salmonella", "s flexneri": "shigella", "s marcescens": "serratia", "v cholerae": "vibrio", "v parahaemolyticus": "vibrio",
    "y pestis": "yersinia", "y enterocolitica": "yersinia",
}
MISSPELT = {"baumanii": "baumannii"}
NO_EPITHET = ("sp", "spp", "species")

#: Strains of the panel by species, Gram-negative first.
PANEL_NEGATIVE = {"escherichia coli": 5, "pseudomonas aeruginosa": 3, "klebsiella pneumoniae": 2, "acinetobacter baumannii": 2, "salmonella enterica": 2, "enterobacter cloacae": 1}
PANEL_POSITIVE = {"staphylococcus aureus": 2, "enterococcus faecalis": 2, "bacillus subtilis": 1}
POTENT_UM, INELIGIBLE = 16.0, 10.0

#: The conditioning grid's axes: (name, values, weights or None).
GRID_AXES = [
    ("mic_um", (2.0, 4.0, 8.0), None),
    ("hc50_um", (128.0, 256.0), None),
    ("selectivity", (-0.5, 0.0, 0.5), (25, 40, 35)),
    ("charge_per_res", (0.50, 0.59, 0.68), None),
    ("mu_h", (0.30, 0.55, 0.80), None),
    ("gravy", (-1.2, -0.2, 0.8), None),
]
GRID_CYSTEINE_CLASS = 1


def panel() -> dict[str, int]:
    return PANEL_NEGATIVE | PANEL_POSITIVE
