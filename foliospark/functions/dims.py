"""Small fixed tables: styles, words, acronyms, headings. All are a few rows, so joins with them are broadcast."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

# Citation styles (id, family, et al. from, separator, list order, title quote, author form, list in full up to, prefix, year in parentheses, italics, case).
STYLES = [
    ("apa7", "author-date", 3, "&", "alphabetical", "none", "all-inverted", None, None, True, True, "sentence"),
    ("harvard", "author-date", 3, "and", "alphabetical", "single", "all-inverted", None, None, True, True, "sentence"),
    ("chicago", "author-date", 4, "and", "alphabetical", "double", "first-inverted", 10, None, False, True, "sentence"),
    ("mla9", "author-page", 3, "and", "alphabetical", "double", "first-inverted", None, None, None, True, "title"),
    ("ieee", "numeric", None, None, "citation-order", "double", "non-inverted", 6, "bracket", None, True, "none"),
    ("vancouver", "numeric", None, None, "citation-order", "none", "vancouver", 6, "dot", None, False, "sentence"),
]
STYLE_SCHEMA = (
    "style_id string, family string, et_al_from int, separator string, ref_order string, title_quote string, author_form string, "
    "full_up_to int, ref_prefix string, year_in_parens boolean, italics boolean, case_mode string"
)

# Acronyms of institutions.
ACRONYMS = {
    "OECD": "Organisation for Economic Co-operation and Development",
    "WHO": "World Health Organization",
    "UNESCO": "United Nations Educational, Scientific and Cultural Organization",
    "UNICEF": "United Nations Children’s Fund",
    "IMF": "International Monetary Fund",
    "WTO": "World Trade Organization",
    "UNDP": "United Nations Development Programme",
    "WEF": "World Economic Forum",
    "ADB": "Asian Development Bank",
    "ILO": "International Labour Organization",
    "FAO": "Food and Agriculture Organization",
    "UNEP": "United Nations Environment Programme",
    "NASA": "National Aeronautics and Space Administration",
    "FDA": "U.S. Food and Drug Administration",
    "CDC": "Centers for Disease Control and Prevention",
    "IEEE": "Institute of Electrical and Electronics Engineers",
    "ISO": "International Organization for Standardization",
    "NATO": "North Atlantic Treaty Organization",
    "ASEAN": "Association of Southeast Asian Nations",
    "IIF": "Institute of International Finance",
    "BPS": "Badan Pusat Statistik",
    "OJK": "Otoritas Jasa Keuangan",
    "BI": "Bank Indonesia",
    "KEMENKEU": "Kementerian Keuangan",
    "KEMENDIKBUD": "Kementerian Pendidikan dan Kebudayaan",
    "BAPPENAS": "Badan Perencanaan Pembangunan Nasional",
    "LIPI": "Lembaga Ilmu Pengetahuan Indonesia",
    "BKPM": "Badan Koordinasi Penanaman Modal",
}

# Words that open a sentence and are no author.
SKIP_WORDS = (
    "the this that these those according see also however therefore furthermore additionally although despite while when where which "
    "what how why if then but for with from into after before during between through about above below under over chapter table figure "
    "section part page volume issue article book report study research data result analysis method model system process program project "
    "case based related compared in on at by to of as moreover meanwhile consequently hence thus similarly conversely nonetheless "
    "nevertheless accordingly subsequently specifically notably overall finally importantly interestingly outside within inside beyond "
    "throughout across among around along against until because recently previously first second third next last lastly menurut namun "
    "selanjutnya kemudian selain meskipun walaupun berdasarkan sebagai sementara sedangkan"
).split()
# Place names that can stand before an author.
PLACE_WORDS = (
    "nigeria indonesia malaysia singapore thailand vietnam philippines india pakistan bangladesh china japan korea africa asia europe america "
    "australia brazil mexico canada egypt kenya ghana ethiopia tanzania uganda zambia zimbabwe morocco algeria sudan iran iraq turkey russia "
    "germany france italy spain portugal britain england scotland ireland netherlands belgium switzerland sweden norway denmark finland poland ukraine greece"
).split()

# Words for reference headings, their near misses and what only looks like one.
REFERENCE_HEADING = "(?iu)(\\breferences?\\b|reference\\s+list|bibliography|works\\s+cited|literature\\s+cited|daftar\\s+pustaka|daftar\\s+referensi|referensi)"
HEADING_WORDS = ["references", "reference", "bibliography", "referensi"]
NOT_HEADINGS = ["preference", "conference", "difference", "deference", "inference", "interference", "reverence"]
INTRODUCTION_HEADING = "(?iu)^(introduction|pendahuluan|latar\\s*belakang)$"

# Section headings by key; the flag says that a heading must be numbered or in capitals.
NUMBERING = "(?:(?:bab|section|chapter)\\s*)?(?:\\d+(?:\\.\\d+)*|[ivxlcdm]+)?[\\.\\):]?\\s*"
SECTIONS = [
    ("abstract", "(abstract|abstrak)\\b\\s*[:.\\-]?\\s*", False, False),
    ("keywords", "(keywords?|kata\\s*kunci)\\b\\s*[:.\\-]?\\s*", False, False),
    ("introduction", NUMBERING + "(introduction|pendahuluan|latar\\s*belakang)\\b", True, True),
    ("method", NUMBERING + "(research\\s*method\\w*|methods?\\b|methodology|metod(e|ologi)(\\s*penelitian)?)", True, True),
    ("results_discussion", NUMBERING + "((research\\s*)?results?\\s*(and|&)\\s*discussions?|hasil(\\s*(penelitian|riset))?\\s*dan\\s*pembahasan)", True, False),
    ("results", NUMBERING + "((research\\s*)?results?\\b|findings?\\b|hasil(\\s*(penelitian|riset))?\\b|temuan(\\s*penelitian)?\\b)", True, True),
    ("discussion", NUMBERING + "(discussions?\\b|pembahasan\\b|diskusi\\b)", True, True),
    ("conclusion", NUMBERING + "(conclusions?\\b(\\s*(and|&)\\s*suggestions?)?|kesimpulan\\b(\\s*dan\\s*saran)?|simpulan\\b|penutup\\b)", True, True),
    ("acknowledgment", NUMBERING + "(acknowledge?ments?\\b|ucapan\\s*terima\\s*kasih\\b)", True, False),
    ("references", NUMBERING + "(references\\b|daftar\\s*pustaka\\b|bibliography\\b|reference\\s*list\\b)", True, False),
]

# How every section heading opens behind its number.
SECTION_OPENINGS = [
    "abstra", "keyword", "kata", "introduction", "pendahuluan", "latar", "research", "method", "metod", "result", "hasil", "finding", "temuan", "discussion",
    "pembahasan", "diskusi", "conclusion", "kesimpulan", "simpulan", "penutup", "acknowledg", "ucapan", "reference", "daftar", "bibliography",
]

# Signs of Indonesian origin.
LOCAL_WORDS = [
    "indonesia", "universitas", "sekolah tinggi", "politeknik", "fakultas", "lppm", "kemdikbud", "kemendikbud", "kemenristek", "kemenkeu",
    "bappenas", "lipi", "brin", "badan pusat statistik", "bps ", "yogyakarta", "jakarta", "bandung", "surabaya", "semarang", "malang",
    "medan", "makassar", "denpasar", "surakarta", "solo", "palembang", "bogor", "bekasi", "tangerang", "depok", "manado", "padang",
    "pekanbaru", "banjarmasin", "aceh", "bali", "jawa", "sumatera", "kalimantan", "sulawesi", "papua",
]


def styles(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(STYLES, STYLE_SCHEMA)


def acronyms(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(ACRONYMS.items()), "acronym string, full_name string")
