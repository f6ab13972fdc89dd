"""Dictionaries of sequence analysis, as plain text, and small DataFrames made of them."""

from __future__ import annotations

from functools import cache

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from strandlake.functions.tables import local_table

# Enzyme, site, cut, cut on the complement, overhang, group.
_ENZYMES = """
EcoRI GAATTC 1 5 5prime common
BamHI GGATCC 1 5 5prime common
HindIII AAGCTT 1 5 5prime common
XhoI CTCGAG 1 5 5prime common
NdeI CATATG 2 4 5prime common
XbaI TCTAGA 1 5 5prime common
SalI GTCGAC 1 5 5prime common
PstI CTGCAG 5 1 3prime common
SphI GCATGC 5 1 3prime common
KpnI GGTACC 5 1 3prime common
NotI GCGGCCGC 2 6 5prime common
SmaI CCCGGG 3 3 blunt common
EcoRV GATATC 3 3 blunt common
StuI AGGCCT 3 3 blunt common
NcoI CCATGG 1 5 5prime common
BglII AGATCT 1 5 5prime common
ClaI ATCGAT 2 4 5prime common
ApaI GGGCCC 5 1 3prime common
SacI GAGCTC 5 1 3prime common
SacII CCGCGG 4 2 3prime common
NheI GCTAGC 1 5 5prime common
MluI ACGCGT 1 5 5prime common
AvrII CCTAGG 1 5 5prime common
ScaI AGTACT 3 3 blunt common
BsaI GGTCTC 7 11 5prime common
AgeI ACCGGT 1 5 5prime common
AflII CTTAAG 1 5 5prime common
SpeI ACTAGT 1 5 5prime common
PvuI CGATCG 4 2 3prime common
PvuII CAGCTG 3 3 blunt common
MboI GATC 0 4 5prime 4cutter
Sau3AI GATC 0 4 5prime 4cutter
MspI CCGG 1 3 5prime 4cutter
HpaII CCGG 1 3 5prime 4cutter
TaqI TCGA 1 3 5prime 4cutter
AluI AGCT 2 2 blunt 4cutter
HaeIII GGCC 2 2 blunt 4cutter
RsaI GTAC 2 2 blunt 4cutter
CfoI GCGC 3 1 3prime 4cutter
HinfI GANTC 1 4 5prime 4cutter
MaeI CTAG 1 3 5prime 4cutter
DpnI GATC 2 2 blunt 4cutter
HpaI GTTAAC 3 3 blunt common
NlaIII CATG 4 0 3prime 4cutter
PacI TTAATTAA 3 5 3prime rare
SwaI ATTTAAAT 4 4 blunt rare
SfiI GGCCNNNNNGGCC 8 4 3prime rare
AscI GGCGCGCC 2 6 5prime rare
FseI GGCCGGCC 6 2 3prime rare
SrfI GCCCGGGC 4 4 blunt rare
PmeI GTTTAAAC 4 4 blunt rare
SgfI GCGATCGC 5 3 3prime rare
McrBC RGNNNNNNNNNNNNNNNNNNNNNNNNNHGY 15 9 5prime methylation
SssI CCGG 1 3 5prime methylation
BbsI GAAGAC 8 12 5prime golden
BtgZI GCGATG 10 14 5prime golden
BsmBI CGTCTC 7 11 5prime golden
SapI GCTCTTC 8 11 5prime golden
LguI GCTCTTC 8 11 5prime golden
AccI GTYRAC 2 4 5prime common
AclI AACGTT 2 4 5prime common
AfeI AGCGCT 3 3 blunt common
AflIII ACRYGT 1 5 5prime common
AgeI ACCGGT 1 5 5prime common
AhdI GACNNNNNGTC 6 5 blunt common
AloI GAACNNNNNNTCC 12 9 5prime common
ApaLI GTGCAC 1 5 5prime common
AseI ATTAAT 2 4 5prime common
AsiSI GCGATCGC 5 3 3prime common
AvaI CYCGRG 1 5 5prime common
AvaII GGWCC 1 4 5prime common
AviII TGCGCA 3 3 blunt common
BclI TGATCA 1 5 5prime common
BglI GCCNNNNNGGC 7 4 3prime common
BlpI GCTNAGC 2 5 5prime common
BmgBI CACGTC 3 3 blunt common
BseYI CCCAGC -5 -1 5prime common
BseRI GAGGAG 10 14 5prime common
BsgI GTGCAG 16 14 3prime common
BsiEI CGRYCG 4 2 3prime common
BsiWI CGTACG 1 5 5prime common
BsmI GAATGC 7 5 5prime common
BspEI TCCGGA 1 5 5prime common
BspHI TCATGA 1 5 5prime common
BsrGI TGTACA 1 5 5prime common
BssHII GCGCGC 1 5 5prime common
BstAPI GCANNNNNTGC 7 4 3prime common
BstBI TTCGAA 2 4 5prime common
BstEII GGTNACC 1 6 5prime common
BstUI CGCG 2 2 blunt common
BstXI CCANNNNNTGG 8 4 5prime common
DraI TTTAAA 3 3 blunt common
DrdI GACNNNNNNGTC 7 6 blunt common
EarI CTCTTC 7 10 5prime common
EciI GGCGGA 11 15 5prime common
Eco47III AGCGCT 3 3 blunt common
EcoNI CCTNNNNNNNAGG 5 8 5prime common
EcoO109I RGGNCCY 2 5 5prime common
EcoRI GAATTC 1 5 5prime common
FspI TGCGCA 3 3 blunt common
MfeI CAATTG 1 5 5prime common
MscI TGGCCA 3 3 blunt common
MspA1I CMGCKG 3 3 blunt common
MunI CAATTG 1 5 5prime common
NaeI GCCGGC 3 3 blunt common
NarI GGCGCC 2 4 5prime common
NgoMIV GCCGGC 1 5 5prime common
NsiI ATGCAT 5 1 3prime common
NspI RCATGY 5 1 3prime common
PflMI CCANNNNNTGG 7 4 3prime common
PmlI CACGTG 3 3 blunt common
PsiI TTATAA 3 3 blunt common
RsrII CGGWCCG 2 5 5prime common
SbfI CCTGCAGG 6 2 3prime common
SciI CTCGAG 1 5 5prime common
SexAI ACCWGGT 1 6 5prime common
SfaNI GCATGNNNNN 10 8 3prime common
SgrAI CRCCGGYG 2 6 5prime common
SmlI CTYRAG 1 5 5prime common
SnaBI TACGTA 3 3 blunt common
SrfI GCCCGGGC 4 4 blunt common
SspI AATATT 3 3 blunt common
StuI AGGCCT 3 3 blunt common
SwaI ATTTAAAT 4 4 blunt rare
XmaI CCCGGG 1 5 5prime common
XmnI GAANNNNTTC 5 5 blunt common
ZraI GACGTC 3 3 blunt common
"""

# Codon usage per thousand codons.
_USAGE = {
    "ecoli": """
        TTT 22.0 TTC 16.2 TTA 13.8 TTG 13.5 CTT 11.6 CTC 10.9 CTA 3.9 CTG 51.3
        ATT 30.6 ATC 24.5 ATA 4.7 ATG 27.3 GTT 18.3 GTC 15.0 GTA 10.8 GTG 25.7
        TAT 16.2 TAC 12.1 TAA 2.0 TAG 0.3 TGT 5.2 TGC 6.3 TGA 1.0 TGG 15.2
        TCT 8.6 TCC 8.7 TCA 7.6 TCG 8.7 CCT 7.2 CCC 5.5 CCA 8.4 CCG 22.6
        ACT 9.0 ACC 22.9 ACA 7.6 ACG 14.4 GCT 15.5 GCC 25.3 GCA 20.3 GCG 32.7
        GAT 32.4 GAC 19.0 GAA 39.3 GAG 18.3 CAT 12.8 CAC 9.4 CAA 15.3 CAG 28.8
        AAT 18.3 AAC 21.4 AAA 33.9 AAG 10.7 CGT 20.7 CGC 21.5 CGA 3.7 CGG 5.7
        AGT 9.0 AGC 15.9 AGA 2.3 AGG 1.5 GGT 24.5 GGC 28.5 GGA 8.1 GGG 11.2
    """,
    "human": """
        TTT 17.6 TTC 20.3 TTA 7.7 TTG 12.9 CTT 13.2 CTC 19.6 CTA 7.2 CTG 39.6
        ATT 16.0 ATC 20.8 ATA 7.5 ATG 22.0 GTT 11.0 GTC 14.5 GTA 7.1 GTG 28.1
        TAT 12.2 TAC 15.3 TAA 1.0 TAG 0.8 TGT 10.6 TGC 12.6 TGA 1.6 TGG 13.2
        TCT 15.2 TCC 17.7 TCA 12.2 TCG 4.4 CCT 17.5 CCC 19.8 CCA 16.9 CCG 6.9
        ACT 13.1 ACC 18.9 ACA 15.1 ACG 6.1 GCT 18.4 GCC 27.7 GCA 15.8 GCG 7.4
        GAT 21.8 GAC 25.1 GAA 29.0 GAG 39.6 CAT 10.9 CAC 15.1 CAA 12.3 CAG 34.2
        AAT 17.0 AAC 19.1 AAA 24.4 AAG 31.9 CGT 4.5 CGC 10.4 CGA 6.2 CGG 11.4
        AGT 12.1 AGC 19.5 AGA 12.2 AGG 12.0 GGT 10.8 GGC 22.2 GGA 16.5 GGG 16.5
    """,
    "yeast": """
        TTT 26.1 TTC 18.2 TTA 26.2 TTG 27.1 CTT 12.3 CTC 5.4 CTA 13.4 CTG 10.4
        ATT 30.1 ATC 17.1 ATA 17.8 ATG 20.9 GTT 22.1 GTC 11.7 GTA 11.8 GTG 10.7
        TAT 18.8 TAC 14.7 TAA 1.1 TAG 0.5 TGT 8.0 TGC 4.7 TGA 0.7 TGG 10.4
        TCT 23.5 TCC 14.2 TCA 18.7 TCG 8.5 CCT 13.5 CCC 6.8 CCA 18.2 CCG 5.3
        ACT 20.3 ACC 12.7 ACA 17.8 ACG 8.0 GCT 21.1 GCC 12.5 GCA 16.2 GCG 6.1
        GAT 37.6 GAC 20.2 GAA 45.6 GAG 19.4 CAT 13.6 CAC 7.8 CAA 27.3 CAG 12.1
        AAT 35.7 AAC 24.8 AAA 41.9 AAG 30.8 CGT 6.3 CGC 2.6 CGA 3.0 CGG 1.7
        AGT 14.2 AGC 9.9 AGA 21.3 AGG 9.2 GGT 23.7 GGC 9.8 GGA 10.9 GGG 6.0
    """,
}

# Substitution scores of the BLOSUM62 matrix, lower triangle.
_BLOSUM62 = """
A 4
R -1 5
N -2 0 6
D -2 -2 1 6
C 0 -3 -3 -3 9
Q -1 1 0 0 -3 5
E -1 0 0 2 -4 2 5
G 0 -2 0 -1 -3 -2 -2 6
H -2 0 1 -1 -3 0 0 -2 8
I -1 -3 -3 -3 -1 -3 -3 -4 -3 4
L -1 -2 -3 -4 -1 -2 -3 -4 -3 2 4
K -1 2 0 -1 -3 1 1 -2 -1 -3 -2 5
M -1 -1 -2 -3 -1 0 -2 -3 -2 1 2 -1 5
F -2 -3 -3 -3 -2 -3 -3 -3 -1 0 0 -3 0 6
P -1 -2 -2 -1 -3 -1 -1 -2 -2 -3 -3 -1 -2 -4 7
S 1 -1 1 0 -1 0 0 0 -1 -2 -2 0 -1 -2 -1 4
T 0 -1 0 -1 -1 -1 -1 -2 -2 -1 -1 -1 -1 -2 -1 1 5
W -3 -3 -4 -4 -2 -2 -3 -2 -2 -3 -2 -3 -1 1 -4 -3 -2 11
Y -2 -2 -2 -3 -2 -1 -2 -3 2 -1 -1 -2 -1 3 -3 -2 -2 2 7
V 0 -3 -3 -3 -1 -2 -2 -3 -3 3 1 -2 1 -1 -2 -2 0 -3 -1 4
"""

# Feature templates: name, type, color, sequence.
_TEMPLATES = """
T7 promoter|promoter|#8b5cf6|TAATACGACTCACTATAGGG
T3 promoter|promoter|#8b5cf6|AATTAACCCTCACTAAAGGG
SP6 promoter|promoter|#8b5cf6|ATTTAGGTGACACTATAG
lac promoter|promoter|#8b5cf6|GCTCGTATAATGTGTGG
T7 terminator|terminator|#ef4444|GCTAGTTATTGCTCAGCGG
6xHis tag|CDS|#f59e0b|CATCACCATCACCATCAC
FLAG tag|CDS|#f59e0b|GATTACAAGGATGACGACGATAAG
HA tag|CDS|#f59e0b|TACCCATACGATGTTCCTGACTATGCGGG
Myc tag|CDS|#f59e0b|GAACAAAAACTCATCTCAGAAGAGGATCTG
AmpR|gene|#10b981|ATGAGTATTCAACATTTCCGTGTCGCCCTTATTCCCTTTTTTGCGGCATTTTGCCTTCCTGTTTTTGCTCACCCAGAAACGCTGGTGAAAGTAAAAGATGCTGAAGATCAGTTGGGTGCACGAGTGGGTTACATCGAACTGGATCTCAACAGCGGTAAGATCCTTGAGAGTTTTCGCCCCGAAGAACGTTTTCCAATGATGAGCACTTTTAAAGTTCTGCTATGTGGCGCGGTATTATCCCGTGTTGACGCCGGGCAAGAGCAACTCGGTCGCCGCATACACTATTCTCAGAATGACTTGGTTGAGTACTCACCAGTCACAGAAAAGCATCTTACGGATGGCATGACAGTAAGAGAATTATGCAGTGCTGCCATAACCATGAGTGATAACACTGCGGCCAACTTACTTCTGACAACGATCGGAGGACCGAAGGAGCTAACCGCTTTTTTGCACAACATGGGGGATCATGTAACTCGCCTTGATCGTTGGGAACCGGAGCTGAATGAAGCCATACCAAACGACGAGCGTGACACCACGATGCCTGCAGCAATGGCAACAACGTTGCGCAAACTATTAACTGGCGAACTACTTACTCTAGCTTCCCGGCAACAATTAATAGACTGGATGGAGGCGGATAAAGTTGCAGGACCACTTCTGCGCTCGGCCCTTCCGGCTGGCTGGTTTATTGCTGATAAATCTGGAGCCGGTGAGCGTGGGTCTCGCGGTATCATTGCAGCACTGGGGCCAGATGGTAAGCCCTCCCGTATCGTAGTTATCTACACGACGGGGAGTCAGGCAACTATGGATGAACGAAATAGACAGATCGCTGAGATAGGTGCCTCACTGATTAAGCATTGG
KanR|gene|#10b981|ATGAGCCATATTCAACGGGAAACGTCTTGCTCGAGGCCGCGATTAAATTCCAACATGGATGCTGATTTATATGGGTATAAATGGGCTCGCGATAATGTCGGGCAATCAGGTGCGACAATCTATCGATTGTATGGGAAGCCCGATGCGCCAGAGTTGTTTCTGAAACATGGCAAAGGTAGCGTTGCCAATGATGTTACAGATGAGATGGTCAGACTAAACTGGCTGACGGAATTTATGCCTCTTCCGACCATCAAGCATTTTATCCGTACTCCTGATGATGCATGGTTACTCACCACTGCGATCCCCGGGAAAACAGCATTCCAGGTATTAGAAGAATATCCTGATTCAGGTGAAAATATTGTTGATGCGCTGGCAGTGTTCCTGCGCCGGTTGCATTCGATTCCTGTTTGTAATTGTCCTTTTAACAGCGATCGCGTATTTCGTCTCGCTCAGGCGCAATCACGAATGAATAACGGTTTGGTTGATGCGAGTGATTTTGATGACGAGCGTAATGGCTGGCCTGTTGAACAAGTCTGGAAAGAAATGCATAAGCTTTTGCCATTCTCACCGGATTCAGTCGTCACTCATGGTGATTTCTCACTTGATAACCTTATTTTTGACGAGGGGAAATTAATAGGTTGTATTGATGTTGGACGAGTCGGAATCGCAGACCGATACCAGGATCTTGCCATCCTATGGAACTGCCTCGGTGAGTTTTCTCCTTCATTACAGAAACGGCTTTTTCAAAAATATGGTATTGATAATCCTGATATGAATAAATTGCAGTTTCATTTGATGCTCGATGAGTTTTTCTAAT
ColE1 ori|rep_origin|#ec4899|CCCTCGAGGGCCTGACGCGCGTCCCGCCCCGGAGTCCGCCCCCGCCCGCGCCCGCCCGCCCCCGCGCCCGCCCGCCGCGCGCCGCGCGCGCCCGG
pUC ori|rep_origin|#ec4899|CCCGTAGAAAAGATCAAAGGATCTTCTTGAGATCCTTTTTTTCTGCGCGTAATCTGCTGCTTGCAAACAAAAAAACCACCGCTACCAGCGGTGGTTTGTTTGCCGGATCAAGAGCTACCAACTCTTTTTCCGAAGGTAACTGGCTTCAGCAGAGCGCAGATACCAAATACTGTGCTTCTAGTGTAGCCGTAGTTAGGCCACCACTTCAAGAACTCTGTAGCACCGCCTACATACCTCGCTCTGCTAATCCTGTTACCAGTGGCTGCTGCCAGTGGCGATAAGTCGTGTCTTACCGGGTTGGACTCAAGACGATAGTTACCGGATAAGGCGCAGCGGTCGGGCTGAACGGGGGGTTCGTGCACACAGCCCAGCTTGGAGCGAACGACCTACACCGAACTGAGATACCTACAGCGTGAGCTATGAGAAAGCGCCACGCTTCCCGAAGGGAGAAAGGCGGACAGGTATCCGGTAAGCGGCAGGGTCGGAACAGGAGAGCGCACGAGGGAGCTTCCAGGGGGAAACGCCTGGTATCTTTATAGTCCTGTCGGGTTTCGCCACCTCTGACTTGAGCGTCGATTTTTGTGATGCTCGTCAGGGGGGCGGAGCCTATGGAAAAACGCCAGCAACGCGGCCTTTTTACGGTTCCTGGCCTTTTGCTGGCCTTTTGCTCACATGTT
GFP|gene|#3b82f6|ATGAGTAAAGGAGAAGAACTTTTCACTGGAGTTGTCCCAATTCTTGTTGAATTAGATGGTGATGTTAATGGGCACAAATTTTCTGTCAGTGGAGAGGGTGAAGGTGATGCAACATACGGAAAACTTACCCTTAAATTTATTTGCACTACTGGAAAACTACCTGTTCCTTGGCCAACACTTGTCACTACTTTCTCTTATGGTGTTCAATGCTTTTCAAGATACCCAGATCATATGAAGCGGCACGACTTCTTCAAGAGCGCCATGCCTGAGGGATACGTGCAGGAGAGGACCATCTTCTTCAAGGACGACGGGAACTACAAGACACGTGCTGAAGTCAAGTTTGAGGGAGACACCCTCGTCAACAGGATCGAGCTTAAGGGAATCGATTTCAAGGAGGACGGAAACATCCTCGGCCACAAGTTGGAATACAACTACAACTCCCACAACGTATACATCATGGCCGACAAGCAAAAGAACGGCATCAAAGTCAACTTCAAGATCCGCCACAACATCGAGGACGGCAGCGTGCAGCTCGCCGACCACTACCAGCAGAACACCCCCATCGGCGACGGCCCCGTGCTGCTGCCCGACAACCACTACCTGAGCACCCAGTCCGCCCTGAGCAAAGACCCCAACGAGAAGCGCGATCACATGGTCCTGCTGGAGTTCGTGACCGCCGCCGGGATCACTCTCGGCATGGACGAGCTGTACAAG
"""

# Fixed values by residue: mass of the free residue, hydropathy, flexibility, rounded mass, charge, polarity.
_RESIDUES = """
A 89.09 1.8 0.36 89.1 0 0
R 174.20 -4.5 0.53 174.2 1 1
N 132.12 -3.5 0.46 132.1 0 1
D 133.10 -3.5 0.51 133.1 -1 1
C 121.16 2.5 0.35 121.2 0 0
E 147.13 -3.5 0.50 147.1 -1 1
Q 146.15 -3.5 0.49 146.2 0 1
G 75.03 -0.4 0.54 75.0 0 0
H 155.16 -3.2 0.32 155.2 0.5 1
I 131.17 4.5 0.46 131.2 0 0
L 131.17 3.8 0.40 131.2 0 0
K 146.19 -3.9 0.47 146.2 1 1
M 149.21 1.9 0.30 149.2 0 0
F 165.19 2.8 0.31 165.2 0 0
P 115.13 -1.6 0.51 115.1 0 0
S 105.09 -0.8 0.51 105.1 0 1
T 119.12 -0.7 0.44 119.1 0 1
W 204.23 -0.9 0.31 204.2 0 0
Y 181.19 -1.3 0.42 181.2 0 1
V 117.15 4.2 0.39 117.1 0 0
"""

# Masses of nucleotides; classes of residues; letters of ambiguous bases; gel ladder.
NUCLEOTIDE_MASS = {"A": 331.2, "T": 322.2, "C": 307.2, "G": 347.2, "U": 308.2}
RESIDUE_CLASSES = {"hydrophobic": "AILMFWVP", "polar": "STYNQHC", "positive": "RK", "negative": "DE", "special": "G"}
AMBIGUOUS = {"R": "AG", "Y": "CT", "S": "GC", "W": "AT", "K": "GT", "M": "AC", "B": "CGT", "D": "AGT", "H": "ACT", "V": "ACG", "N": "ACGT"}
LADDER = [10000, 8000, 6000, 5000, 4000, 3000, 2000, 1500, 1000, 750, 500, 250, 100]
MOTIFS = [("TATA box", "TATAAA"), ("EcoRI", "GAATTC"), ("BamHI", "GGATCC"), ("HindIII", "AAGCTT"), ("Start codon", "ATG"), ("Stop codons", "T(AA|AG|GA)"), ("CAAT box", "CCAAT")]
#: Order of residues in one-hot vectors.
RESIDUE_ORDER = "ARNDCQEGHILKMFPSTWYV"
NOT_LIGANDS = ["HOH", "WAT", "TIP3", "SOL", "NA", "CL", "K", "MG", "CA", "ZN", "MN", "FE", "SO4", "PO4"]
THREE_LETTER = dict(zip("ALA ARG ASN ASP CYS GLN GLU GLY HIS ILE LEU LYS MET PHE PRO SER THR TRP TYR VAL".split(), "ARNDCQEGHILKMFPSTWYV", strict=True))


@cache
def codon_table() -> dict[str, str]:
    """Codon to residue, by the standard code; in order of the second, first and third base."""
    bases = "TCAG"
    residues = "FFLLSSSSYY**CC*WLLLLPPPPHHQQRRRRIIIMTTTTNNKKSSRRVVVVAAAADDEEGGGG"
    by_first = {a + b + c: residues[16 * i + 4 * j + k] for i, a in enumerate(bases) for j, b in enumerate(bases) for k, c in enumerate(bases)}
    return dict(sorted(by_first.items(), key=lambda p: [bases.index(p[0][i]) for i in (1, 0, 2)]))


@cache
def enzyme_rows() -> list[tuple]:
    """(name, site, cut, cut_complement, overhang, group), the first row of each name and site."""
    rows: dict[tuple, tuple] = {}
    for line in _ENZYMES.split("\n"):
        if line.strip():
            name, site, cut, back, overhang, group = line.split()
            rows.setdefault((name, site), (name, site, int(cut), int(back), overhang, group))
    return sorted(rows.values())


@cache
def usage_rows() -> list[tuple]:
    """(organism, codon, aa, per_thousand, codon_order) of every codon of every organism."""
    order = {c: i for i, c in enumerate(codon_table())}
    rows = []
    for organism, text in _USAGE.items():
        words = text.split()
        rows += [(organism, c, codon_table()[c], float(f), order[c]) for c, f in zip(words[::2], words[1::2], strict=True)]
    return sorted(rows, key=lambda r: (r[0], r[4]))


@cache
def best_codons(organism: str) -> dict[str, str]:
    """Most frequent codon of every residue, the first in codon-table order on ties."""
    best: dict[str, tuple] = {}
    for o, codon, aa, f, at in usage_rows():
        if o == organism and (aa not in best or (-f, at) < best[aa][:2]):
            best[aa] = (-f, at, codon)
    return {aa: v[2] for aa, v in best.items()}


@cache
def blosum62() -> dict[tuple[str, str], int]:
    lines = [line.split() for line in _BLOSUM62.strip().split("\n")]
    names = [line[0] for line in lines]
    half = {(names[i], names[j]): int(v) for i, line in enumerate(lines) for j, v in enumerate(line[1:])}
    return half | {(b, a): v for (a, b), v in half.items()}


@cache
def template_rows() -> list[tuple]:
    """(name, type, color, sequence) of the feature templates."""
    return [tuple(line.split("|")) for line in _TEMPLATES.strip().split("\n")]


@cache
def residue_scales() -> dict[str, dict[str, float]]:
    names = ["weight", "hydropathy", "flexibility", "mass", "charge", "polarity"]
    out: dict[str, dict[str, float]] = {n: {} for n in names}
    for line in _RESIDUES.strip().split("\n"):
        aa, *values = line.split()
        for n, v in zip(names, values, strict=True):
            out[n][aa] = float(v)
    return out


def lookup(mapping: dict, key: Column, default) -> Column:
    """mapping[key] as a literal map, or the default."""
    pairs = F.create_map(*[F.lit(x) for pair in mapping.items() for x in pair])
    return F.coalesce(pairs[key], F.lit(default))


def enzymes(spark: SparkSession) -> DataFrame:
    return local_table(spark, enzyme_rows(), "name string, site string, cut int, cut_complement int, overhang string, group string")


def usage_tables(spark: SparkSession) -> DataFrame:
    return local_table(spark, usage_rows(), "organism string, codon string, aa string, per_thousand double, codon_order int")


def feature_library(spark: SparkSession) -> DataFrame:
    return local_table(spark, template_rows(), "name string, type string, color string, sequence string")


def as_class(site: str) -> str:
    """A regular expression of a site with ambiguous bases."""
    return "".join(f"[{AMBIGUOUS[c]}]" if c in AMBIGUOUS else c for c in site.upper())


def values_sql(rows: list[tuple], columns: str) -> str:
    """(VALUES ...) AS t(columns) of literal rows, for SQL."""
    text = lambda v: "'" + v.replace("'", "''") + "'" if isinstance(v, str) else repr(v)
    return "(SELECT * FROM (VALUES " + ", ".join("(" + ", ".join(map(text, r)) + ")" for r in rows) + f") AS t({columns}))"
