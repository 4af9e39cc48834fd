"""Residue tables, column roles, weights and small dimension tables."""

from __future__ import annotations

# ---------------------------------------------------------------------------
# Fixed values. These must stay exactly as they are for results to be right.
# ---------------------------------------------------------------------------

AMINO_ACIDS = "ACDEFGHIKLMNPQRSTVWY"
HYDROPHOBIC = "AILMFVWP"
HYDROPHILIC = "RKDENQSTY"
POSITIVE = "RKH"
NEGATIVE = "DE"
AROMATIC = "FWY"

# Hydropathy scale of Kyte and Doolittle (1982).
HYDROPATHY = {
    "A": 1.8, "C": 2.5, "D": -3.5, "E": -3.5, "F": 2.8, "G": -0.4, "H": -3.2, "I": 4.5,
    "K": -3.9, "L": 3.8, "M": 1.9, "N": -3.5, "P": -1.6, "Q": -3.5, "R": -4.5, "S": -0.8,
    "T": -0.7, "V": 4.2, "W": -0.9, "Y": -1.3,
}

# Residue volumes in cubic angstrom.
VOLUME = {
    "A": 88.6, "C": 108.5, "D": 111.1, "E": 138.4, "F": 189.9, "G": 60.1, "H": 153.2,
    "I": 166.7, "K": 168.6, "L": 166.7, "M": 162.9, "N": 114.1, "P": 112.7, "Q": 143.8,
    "R": 173.4, "S": 89.0, "T": 116.1, "V": 140.0, "W": 227.8, "Y": 193.6,
}

# Letters that count as polar in the basic descriptor set.
BASIC_POLAR = "RNDQEHKSTY"

# Average masses of the free amino acids and of water, in dalton.
AMINO_ACID_MASS = {
    "A": 89.0932, "C": 121.1582, "D": 133.1027, "E": 147.1293, "F": 165.1891, "G": 75.0666,
    "H": 155.1546, "I": 131.1729, "K": 146.1876, "L": 131.1729, "M": 149.2113, "N": 132.1179,
    "P": 115.1305, "Q": 146.1445, "R": 174.201, "S": 105.0926, "T": 119.1192, "V": 117.1463,
    "W": 204.2252, "Y": 181.1885,
}
WATER_MASS = 18.0153

# pK values of Bjellqvist et al. (1993).
PK_POSITIVE = {"K": 10.0, "R": 12.0, "H": 5.98}
PK_NEGATIVE = {"D": 4.05, "E": 4.45, "C": 9.0, "Y": 10.0}
PK_N_TERMINUS = 7.5
PK_C_TERMINUS = 3.55
PK_N_TERMINUS_BY_RESIDUE = {
    "A": 7.59, "M": 7.0, "S": 6.93, "P": 8.36, "T": 6.82, "V": 7.44, "E": 7.7,
}
PK_C_TERMINUS_BY_RESIDUE = {"D": 4.55, "E": 4.75}
PI_RANGE = (4.05, 12.0)

# Letters that favour helix, turn and sheet. Published sets differ, so they are parameters.
HELIX = "EMALK"
TURN = "NPGSD"
SHEET = "VIYFWLT"

# Column roles per category.
CATEGORY_ROLES = {
    "amp": {"activity": "probability_active", "structure": "sequence"},
    "schiff_base": {
        "activity": "probability_active", "structure": "product",
        "weight": "MW", "logp": "LogP", "tpsa": "TPSA",
    },
    "repurposed": {
        "activity": "probability_active", "structure": "smiles", "weight": "MW", "logp": "LogP",
    },
    "polyphenol": {
        "activity": "probability_active", "structure": "smiles", "weight": "MW", "logp": "LogP",
    },
    "protac": {"activity": "probability_active", "structure": "smiles", "weight": "MW"},
}

COMPONENT_WEIGHTS = {"activity": 0.5, "druglikeness": 0.3, "diversity": 0.2}
PEPTIDE_VIABILITY_WEIGHTS = {
    "activity": 0.5, "hydrophobicity": 0.2, "charge": 0.15, "length": 0.15,
}

LINKERS = [
    ("short", "CCC"),
    ("medium", "CCCCCC"),
    ("long", "CCCCCCCCCC"),
    ("PEG", "CCOCCOCC"),
    ("aryl", "c1ccccc1"),
]
DEFAULT_E3_LIGAND = "O=C(NCC1=CC=CC=C1)C2=CC=C(O)C=C2"
DEFAULT_HYBRID_LINKER = "CCC"

TARGETS = [
    ("LpxC", "LpxC (UDP-3-O-(R-3-hydroxyacyl)-glucosamine N-deacetylase)", "Gram-negative"),
    ("ClpP", "ClpP (Caseinolytic protease)", "Gram-positive"),
    ("FtsH", "FtsH (membrane protease)", "Gram-negative"),
    ("DegP", "DegP (serine protease)", "Gram-negative"),
]

REFERENCE_ACTIVES = [
    ("Halicin", "CS(=O)(=O)N1CCN(CC1)C1=NC(=O)N(C(=O)N1)C1=CC=C(C=C1)Cl"),
    ("Metronidazole", "CC1=NC=C(N1CCO)[N+](=O)[O-]"),
    ("Nitrofurantoin", "CC1C(OC(=O)C1N2C(=O)C3C2C=CC3=O)C=O"),
]

HYBRID_MOTIFS = [
    ("curcumin_core", "CC(=O)CC(C)=CC1=CC=C(O)C(OC)=C1"),
    ("beta_diketone", "CC(=O)CH2C(=O)CH3"),
    ("phenyl_butadiene", "c1ccccc1C=CC=CC"),
]

_SHARED_PRODUCTS = [
    ("Curcumin", "CC(=O)CC(C)=CC1=CC=C(O)C(OC)=C1"),
    ("Resveratrol", "OC1=CC=C(C=C1)C=CC1=CC(O)=CC(O)=C1"),
    ("Quercetin", "OC1=C(O)C=C2C(=O)C3C(O)=C(O)C(C3OC2=C1)=O"),
    ("Epigallocatechin gallate",
     "CC1(C)OC2=C(C1)OC3=C(C2=O)C=C(C=C3O)C4=CC(C5=C(C=C(C5)O)O)C(=O)O"),
    ("Hydroxytyrosol", "OC1=CC=C(O)C(CO)=C1"),
    ("Caffeic acid", "OC1=CC=C(C=CC(O)=O)C1"),
    ("Ferulic acid", "COC1=C(C=CC(=C1)C=CC(O)=O)C"),
    ("Gallic acid", "OC1=CC(O)=C(O)C(O)=C1"),
    ("Ellagic acid", "OC1=C(O)C2=C(C=C1O)C1=C(O)C(=O)C3=C(O)C(O)=C(O)C3=C1C2=O"),
]
NATURAL_PRODUCTS = _SHARED_PRODUCTS + [
    ("Rutin",
     "CC1C(C(C(C(O1)OC2C(C(C(C(O2)OC3=C(OC4=C(C3=C(C=C4)C5=C(C6=C(C=C5O)C(=O)C(O)=C6O)"
     "C(=O)O)C)CO)O)O)O)O)O)(C)O"),
]
STARTING_POINTS = _SHARED_PRODUCTS + [
    ("Epicatechin", "OC1C2C(OC3=C(C2=O)C=C(C=C3O)C1CO)CO"),
]

# Substitution rules: (text to find, replacement).
ANALOG_RULES = [
    ("O", "OC"), ("O", "OC1=CC=CC=C1"), ("O", "OC1=CC=C(O)C=C1"), ("O", "OC1=CC=C(C)C=C1"),
    ("O", "OC1=CC(OC)=C(OC)C=C1"), ("O", "N"), ("O", "NCCO"), ("O", "NC(=O)C"),
]
HOP_RULES = [
    ("c1ccccc1", "c1ccncc1"), ("c1ccccc1", "c1ccoc1"), ("c1ccccc1", "C1CCCCC1"),
    ("c1ccccc1", "c1ccc2ccccc2c1"), ("C=C", "C=N"), ("C=C", "C#C"), ("C=O", "C=NN"),
]
MIMIC_RULES = [
    ("C", "c1ccccc1"), ("CC", "C1CCCCC1"), ("N", "N1CCCC1"), ("O", "O1CCCC1"),
    ("S", "S1CCCC1"),
]

KNOWN_WARHEADS = [
    "CC(C)CC1=CC=C(C=C1)C(=O)O", "CC1=CC=C(C=C1)C(=O)O", "OC1=CC=C(C=C1)C(=O)O",
]
KNOWN_ACTIVES = [
    "CC1=NC=C(N1CCO)[N+](=O)[O-]", "O=C1C2C(CC1=O)CC(=O)N2O",
    "CN1C(=O)CN=C(C1C1=CC=CC=C1Cl)C1=CC=CC=C1",
]
KNOWN_INACTIVES = ["CC(C)Cc1ccc(cc1)C(C)C(O)=O", "CC(N)C(=O)O", "c1ccccc1"]

TARGET_ORGANISMS = ["E. coli", "S. aureus", "P. aeruginosa", "B. subtilis", "K. pneumoniae"]

SEARCH_TERMS = [
    "antibacterial drug FDA approved", "antibiotic FDA approved", "antimicrobial drug",
]
SUBSET_DRUG_NAMES = [
    "ciprofloxacin", "levofloxacin", "azithromycin", "ampicillin", "amoxicillin", "cephalexin",
    "doxycycline", "minocycline", "sulfamethoxazole", "trimethoprim", "nitrofurantoin",
    "tetracycline", "chloramphenicol", "vancomycin", "linezolid",
]
APPROVED_DRUG_NAMES = [
    "ciprofloxacin", "levofloxacin", "moxifloxacin", "azithromycin", "ampicillin",
    "amoxicillin", "cephalexin", "doxycycline", "minocycline", "sulfamethoxazole",
    "trimethoprim", "nitrofurantoin", "tetracycline", "chloramphenicol", "vancomycin",
    "linezolid", "daptomycin", "colistin", "polymyxin B", "rifampicin", "gentamicin",
    "amikacin", "tobramycin", "cefepime", "cefazolin", "meropenem", "imipenem", "ertapenem",
    "piperacillin", "ticarcillin", "halicin", "clofoctol", "triclosan", "triclosan",
]

# ---------------------------------------------------------------------------
# Settings of this library.
# ---------------------------------------------------------------------------

SEED = 42

# Tables used as the broadcast side of a join never exceed this many rows; every such join
# counts the side first and takes a shuffled form above it.
BROADCAST_ROWS = 100_000

# Structure keys of ours: presence patterns read from the structure text.
STRUCTURE_KEYS = [
    r"\[", r"Cl", r"Br", r"F", r"I", r"S", r"P", r"N", r"O", r"n", r"o", r"s", r"=O", r"=N",
    r"#", r"C\(=O\)O", r"C\(=O\)N", r"NC\(=O\)", r"S\(=O\)", r"c1", r"C1", r"2", r"3",
    r"\(C\)", r"OC", r"CO", r"NC", r"CN", r"C=C", r"\.", r"CCC", r"\(O\)",
]
