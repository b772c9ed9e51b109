"""Motif families of promoters (survey F7)."""

from __future__ import annotations

#: The 31 families and their IUPAC patterns; counts must equal those of the published tables.
FAMILIES = {
    "TATA_box": ["TATAAA", "TATAWAW", "TATAWAR"],
    "CAAT_box": ["CAAT", "CCAAT", "CAAAT"],
    "Initiator": ["[CT][CT]A[ATGC][AT][CT][CT]"],
    "MYB_binding": ["[CT]AACNG", "YAACKG", "CAACAG"],
    "bZIP_binding": ["[TG]GACGT[CA]", "ACGT", "CACGTG"],
    "WRKY_binding": ["[CT]TGAC[CT]", "TTGACY"],
    "AP2_ERF": ["GCCGCC", "AGCCGCC"],
    "bHLH_binding": ["CANNTG", "CACGTG", "CATGTG"],
    "NAC_binding": ["CACG", "CATGTG"],
    "GATA_binding": ["[AT]GATA[AG]", "HGATAR"],
    "DOF_binding": ["AAAGG", "AAAG"],
    "TCP_binding": ["GGNCCCAC"],
    "HSF_binding": ["GAANNTTC", "GAANNTTCNNGAANNTTC"],
    "ABA_response": ["ACGTGG[CT]", "ACGTGTC"],
    "Auxin_response": ["TGTCTC", "GAGACA"],
    "GA_response": ["TAACAAA", "TATCCAC"],
    "Cytokinin_response": ["TATTAG", "AGATCCT"],
    "Ethylene_response": ["ATTTCAAA", "TAAGAGCCGCC"],
    "Drought_response": ["TACCGACAT", "ACGTGG[CT]"],
    "Cold_response": ["TGGCCGAC", "CCGAC"],
    "Heat_response": ["GAANNTTC"],
    "Light_response": ["ACGT", "CAATCA", "ATCTTA"],
    "Root_specific": ["ATATT", "TTATT"],
    "Leaf_specific": ["CAATCA", "ATCTTA"],
    "Seed_specific": ["ACAAAA", "CATGCA"],
    "CpG_island": ["CG"],
    "GC_box": ["GGGCGG", "CCGCCC"],
    "E_box": ["CANNTG"],
    "CCAAT_box": ["CCAAT"],
    "Silencer": ["AATTT"],
    "Enhancer": ["TGACGT[CA]"],
}
