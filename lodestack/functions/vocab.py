"""Vocabularies that the rules take as parameters.

Fixed values, down to PLANS: word lists and patterns that must equal those of the retrieval application whose results
are to be matched. Lists of a vendor's products are left out, but for the short names of
parts and drives that TOPICS, DOOR and TECHNICAL hold (dw, dfc, ovf, cfw); callers pass their own. Patterns are for text without
accents.
"""

STOP_WORDS = ("de", "do", "da", "dos", "das", "um", "uma", "o", "a", "os", "as", "e", "ou", "em", "no", "na", "nos", "nas", "com", "para", "por", "se", "que", "pdf")
PHRASE_STOP_WORDS = ("DE", "DO", "DA", "NO", "NA", "EM", "POR", "PARA", "COM", "OS", "AS", "UM", "UMA", "QUE", "SEM", "NOS", "NAS")
FAULT_HINTS = ("UV", "OV", "OC", "OH", "OL", "FU", "MC", "DC", "PUV", "CUV", "EF", "GF")
TOPICS = {
    "porta": r"\b(porta|dw|dfc|intertrav|trinco)\b",
    "seguranca": r"\b(seguranca|es|cadeia\s+de\s+seguranca)\b",
    "controle": r"\b(controlador|controle|placa|modulo|cpu)\b",
    "drive": r"\b(drive|inversor|vetorial|vfd|ovf|cfw)\b",
    "resgate": r"\b(resgate|emergencia|automacao\s+de\s+resgate)\b",
    "parametros": r"\b(parametro|parametrizacao|ajuste|calibracao)\b",
    "eletrico": r"\b(diagrama|esquema|ligacao|borne|fiao|aterramento)\b",
}
NOT_CONTROLLERS = ("HTTP", "HTTPS", "PAGE", "PDF")
VERSION = r"\b(GEN\s?\d|G\d|V\d{1,2}|VERSAO\s?\d{1,2})\b"
GENERIC_PHRASES = ("contém uma tabela", "a página contém", "análise da página", "extração detalhada", "não foi possível")
TABLE_PHRASES = ("indicação do display", "ação corretiva", "códigos de falhas")
GREETINGS = ("oi", "ola", "bom dia", "boa tarde", "boa noite", "e ai", "opa")
META_DOCS = (
    r"quais\s+(modelos?|documentos?|manuais)", r"que\s+(modelos?|documentos?|manuais)", r"quais\s+equipamentos", r"lista\s+de\s+(modelos?|documentos?)",
    r"voces?\s+tem\s+documentac", r"me\s+(lista|mostra|diz)\s+(os|quais)",
)
GENERAL_MANUAL = (r"nocoes\s*gerais", r"falhas\s*comuns")
DOOR = ("porta", "dw", "dfc")
DOOR_CYCLE = r"abr(e|indo)[^\n]*(fech|fecha)|fech(a|ando)[^\n]*(abr|abre)"
NO_START = r"nao\s+parte|nao\s+sobe|nao\s+arranca|nao\s+anda"
MODEL_CODES = (r"[a-z]{1,5}\s?-?\s?[0-9]{1,5}[a-z]?", r"[0-9]{3,5}[a-z]{0,3}", r"gen\s?[0-9][a-z]*|g[0-9]", r"[a-z]{3}[0-9]{4,}[a-z]*")
TECHNICAL = (
    "falha", "erro", "codigo", "defeito", "problema", r"nao\s+funciona", r"nao\s+liga", r"nao\s+sobe", r"nao\s+desce", r"nao\s+fecha", r"nao\s+abre", r"abre\s+e\s+fecha",
    "porta", "trinco", "intertrav", "dw", "dfc", "es", "ligacao", "esquema", "placa", "drive", "inversor", "calibracao", "ajuste", "manual", "resgate", "freio", "encoder", "motor",
)
#: These also count as the beginning of a longer word.
TECHNICAL_BEGINNINGS = ("parametr", "configura", "nivel", "vibra")
GENERIC_INDICATORS = ("qualquer", "todos", "geral", "tudo")
TROUBLE = ("troubleshooting", r"divers[oa]s?\s+falhas|falhas\s+divers[oa]s?")
FOREIGN_MARKERS = ("fuente", "pagina", "averia", "falla", "usted", "puede", "source", "page", "warning", "please", "check", r"error\ code")
CLARIFY_MARKERS = (
    "preciso destes dados", "me confirme", "me informe", "para te responder com precisão", "qual desses equipamentos", "poderia informar", "me diga", "você está trabalhando",
    "me especifique", "preciso saber", "confirme o modelo", "qual geração", "informe o modelo", "qual desses",
)
CHOICES = ("qual desses", "qual modelo", "qual equipamento", "qual placa")
#: What a user tells of a fault: patterns, the first that fits decides, and the name to give, None for the first group.
FACETS = {
    "symptom": (
        (r"(porta\s+abre\s+e\s+fecha)", "porta abre e fecha"), (r"(nao\s+parte|nao\s+anda|nao\s+funciona)", None), (r"(nao\s+sobe|nao\s+desce)", None), (r"(nao\s+fecha|nao\s+abre)", None),
        (r"(nao\s+liga)", "nao liga"), (r"(trem?e|vibra|ruido)", None), (r"(para\s+entre\s+andares|para\s+no\s+meio)", "para entre andares"), (r"(desnivelad|desenivel)", "desnivelamento"),
    ),
    "error_code": ((r"\berro\s+([a-z]?\d{2,4})\b", None), (r"\bcodigo\s+([a-z]?\d{2,4})\b", None), (r"\bfalha\s+([a-z]?\d{2,4})\b", None), (r"\b(e\d{3})\b", None), (r"\b(uv\d{1,2})\b", None), (r"\b(oc\d{1,2})\b", None), (r"\b(ol\d{1,2})\b", None)),
    "part_number": ((r"\b([a-z]{3}\d{4,}[a-z]*)\b", None),),
}
TABLE_SEPARATOR = r"^\|?\s*[:\-]{2,}(\s*\|\s*[:\-]{2,})+\|?$"
CONTINUED = " [continuação] | "

# Invented from here on.

#: Plans with their monthly price and daily limit of queries; null is no limit.
PLANS = {"AUTOMOBILE": (49.0, 5), "BUILDING": (99.0, 20), "FURNITURE": (19.0, 1), "HOUSEHOLD": (29.0, 2), "MACHINERY": (199.0, None)}
