"""Default lexicons, as data: every operator takes its patterns as parameters."""

# Fixed values that results depend on.
APPEAL = [r"PROJUDI\s*[-–—]\s*Recurso", r"Recurso\s+Especial", r"Recurso\s+Extraordin[aá]rio", r"Agravo\s+(?:em\s+Recurso\s+Especial|Regimental|Interno)",
          r"AREsp\b", r"Embargos?\s+de\s+Declara(?:[çc][aã]o)", r"recurso\s+de\s+revista", r"raz[oõ]es\s+recursais", r"art\.\s*105\s*,\s*III",
          r"art\.\s*102\s*,\s*III", r"interposi[cç][aã]o\s+de\s+recurso", r"petição\s+de\s+recurso"]
RULING = [r"AC[OÓ]RD[AÃ]O", r"Vistos\s*,\s*relatados\s+e\s+discutidos", r"C[aâ]mara\s+C[ií]vel", r"EMENTA", r"ACORDAM", r"Rel(?:ator|atora)\s*:",
          r"TRIBUNAL\s+DE\s+JUSTI[CÇ]A"]
CHEAP_APPEAL = [r"recurso\s+especial", r"recurso\s+extraordin[aá]rio", r"agravo\s+(?:em\s+recurso|regimental|interno)", r"aresp\b", r"raz[oõ]es\s+recursais",
                r"art\.\s*105\s*,\s*iii", r"art\.\s*102\s*,\s*iii"]
CHEAP_RULING = [r"ac[óo]rd[aã]o", r"ementa", r"acordam", r"vistos\s*,\s*relatados", r"c[aâ]mara\s+c[ií]vel"]
NOISE_LINES = [r"p[áa]gina\s+\d+(\s+de\s+\d+)?", r"\d+\s*/\s*\d+", r"documento\s+assinado\s+digitalmente.*", r"assinado\s+eletronicamente.*", r"c[óo]digo\s+verificador.*",
               r"c[óo]digo\s+de\s+autentica[çc][ãa]o.*", r"consulte\s+autenticidade.*", r"https?://\S+", r"[-_=*~]{4,}"]
PROTECTED_LINE = r"\b(art\.?|artigo|lei|cpc|cc|cf|constitui[çc][ãa]o|s[úu]mula|sumula|resp|recurso|ac[óo]rd[ãa]o|processo|apel[aã]o|agravo|tema)\b"
REDACT_PARTIAL = [(r"(?i)sk-or-[A-Za-z0-9_\-]{8,}", "[REDACTED_OPENROUTER_KEY]"), (r"(?i)sk-[A-Za-z0-9_\-]{8,}", "[REDACTED_OPENAI_KEY]"),
                  (r"(?i)(bearer\s+)[A-Za-z0-9._\-]{8,}", "$1[REDACTED_TOKEN]"), (r"\b\d{7}-\d{2}\.\d{4}\.\d\.\d{2}\.\d{4}\b", "[REDACTED_PROCESSO]"),
                  (r"\b\d{20}\b", "[REDACTED_PROCESSO]"), (r"\b\d{3}\.?\d{3}\.?\d{3}-?\d{2}\b", "[REDACTED_CPF]"),
                  (r"\b\d{2}\.?\d{3}\.?\d{3}/?\d{4}-?\d{2}\b", "[REDACTED_CNPJ]")]
REDACT_FULL = [(r"(?iu)\b(recorrente|recorrido|agravante|agravado|apelante|apelado|embargante|embargado|impetrante|impetrado|autor(?:a)?|r[ée]u|exequente|executado|"
                r"parte\s+autora|parte\s+r[ée])\b(\s*[:=\-]\s*)([^\n,;|]{3,120})", "$1$2[REDACTED_PARTY_NAME]"),
               (r"(?iu)\b(nome(?:\s+da)?\s+parte)\b(\s*[:=\-]\s*)([^\n,;|]{3,120})", "$1$2[REDACTED_PARTY_NAME]")]
STRONG_OBSTACLES = [5, 7, 13, 83, 126, 211, 518, 279, 280, 281, 282, 283, 284, 356, 735]
TAXONOMY = {"STJ": [5, 7, 13, 83, 126, 211, 518], "STF": [279, 280, 281, 282, 283, 284, 356, 735]}
INADMIT = ["não conhecido", "nao conhecido", "não conhecimento", "nao conhecimento", "inadmiss", "não admit", "nao admit"]
ADMIT = [r"\brecurso\s+conhecid[oa]\b", r"\bconhecimento\s+do\s+recurso\b", r"\badmit[eo]\s+o\s+recurso\b", r"\badmitid[oa]\b", r"\bju[ií]zo\s+positivo\s+de\s+admissibilidade\b"]
STOP_WORDS = "de da do das dos e ou a o as os no na nos nas por para com sem em que sobre ao aos à às".split()
TRANSIENT_NAMES = ["RateLimitError", "APITimeoutError", "APIConnectionError", "TimeoutError", "ConnectionError", "ServiceUnavailableError"]
TRANSIENT_HINTS = ["rate limit", "429", "temporar", "timeout", "connection reset", "network"]
GATES = {"extraction_useful_pages_rate": 0.995, "etapa1_critical_fields_accuracy": 0.98, "etapa2_proxy_f1": 0.97, "etapa3_decisao_accuracy": 0.99,
         "critical_evidence_failures_zero": 1.0}
