"""Fixed values of the record sheets: names, spellings and patterns that results depend on."""

# Words that mark a header row.
HEADER_WORDS = (
    "depart", "munic", "codigo", "dane", "arma", "medio", "fecha",
    "genero", "sexo", "edad", "agrupa", "cantidad", "total",
)

# Column-name patterns (whole name) and the standard name they stand for.
COLUMN_SYNONYMS = {
    r"depto|dep|departamento|dpto": "departamento",
    r"municipio|ciudad|mpio|municpio|munici?p[io]": "municipio",
    r"codigo_dane|cod_dane|codigo_dane_municipio|codigodane|coddane": "codigo_dane",
    r"arma_s?_?medios?|armas?_?medios?|arma|medio|armamedio|arma_emple.*": "arma_medio",
    r"fecha|fecha_hecho|fecha_del_hecho|fec_hecho": "fecha_hecho",
    r"genero|sexo": "genero",
    r"agrupa_edad_persona|grupo_edad|rango_edad|edad_grupo|grupo_etario|agrupa_edad": "agrupa_edad_persona",
    r"cantidad|total|nro_casos|num_casos|casos": "cantidad",
}

# Standard column order of the unified table.
STANDARD_COLUMNS = (
    "departamento", "municipio", "codigo_dane", "arma_medio", "fecha_hecho",
    "genero", "agrupa_edad_persona", "cantidad", "ANIO", "DELITO",
)

# Upper-case header spellings of the yearly sheets.
HEADER_RENAMES = {
    "ARMA_MEDIO": "ARMAS_MEDIOS", "ARMAS_MEDIO": "ARMAS_MEDIOS", "ARMAS/MEDIOS": "ARMAS_MEDIOS",
    "ARMAS_Y_MEDIOS": "ARMAS_MEDIOS", "FECHA": "FECHA_HECHO", "MUNICICPIO": "MUNICIPIO",
    "DEPARTAMENTO_": "DEPARTAMENTO", "*AGRUPA_EDAD_PERSONA": "AGRUPA_EDAD_PERSONA",
    "*AGRUPA_EDAD_PERSONA*": "AGRUPA_EDAD_PERSONA", "AGRUPA_EDAD_PER_SONA": "AGRUPA_EDAD_PERSONA",
}

# Columns kept from a yearly sheet.
SHEET_COLUMNS = (
    "DEPARTAMENTO", "MUNICIPIO", "CODIGO_DANE", "ARMAS_MEDIOS",
    "FECHA_HECHO", "GENERO", "AGRUPA_EDAD_PERSONA", "CANTIDAD",
)

# Header rows tried for a sheet, and the rows tried when nothing is recognised.
HEADER_CANDIDATES = (9, 10, 11, 12, 8, 7, 6, 13, 14, 15)
HEADER_FALLBACKS = (8, 9, 0)

# Patterns of footer lines (lower case) and of junk rows.
TOTAL_LINE = r"(^|\s)total(\s|:|$)"
SOURCE_LINE = r"fuente|siedco|dijin|elaborado:|revisado:|autorizado:"
JUNK_ROW = r"(?iu)TOTAL|FUENTE|Elaborado|Revisado|Autorizado|Ley 1098|Agrupación referente|Contador"
JUNK_ROW_LONG = (
    r"(?iu)TOTAL|FUENTE|SIEDCO|Elaborado|Revisado|Autorizado|Ley 1098|Agrupación referente|Contador|DUIN|"
    r"POLICÍA NACIONAL|DIRECCIÓN|GRUPO DE INFORMACIÓN|LESIONES|PERÍODO|MINISTERIO"
)

# Department keys and what a weapon looks like, for rows with both columns exchanged.
DEPARTMENT_KEYS = (
    "AMAZONAS", "ANTIOQUIA", "ARAUCA", "ATLANTICO", "BOLIVAR", "BOYACA", "CALDAS", "CAQUETA", "CASANARE",
    "CAUCA", "CESAR", "CHOCO", "CORDOBA", "CUNDINAMARCA", "GUAINIA", "GUAVIARE", "HUILA", "LA GUAJIRA",
    "MAGDALENA", "META", "NARINO", "NORTE DE SANTANDER", "PUTUMAYO", "QUINDIO", "RISARALDA", "SAN ANDRES",
    "SANTANDER", "SUCRE", "TOLIMA", "VALLE DEL CAUCA", "VAUPES", "VICHADA", "BOGOTA", "BOGOTA DC",
    "BOGOTA D C", "ARCHIPIELAGO DE SAN ANDRES",
)
WEAPON_WORDS = (
    "ARMA|FUEGO|BLANCA|CORTO|PUNZ|CONTUND|ESCOPOL|VENEN|QUIMI|GAS|OBJETO|ARTEFACTO|SUSTANCIA|"
    "SIN EMPLEO|NO REPORT|CINTA|ESPOSA"
)

# Official spelling by department key; keys not listed keep their own spelling.
DEPARTMENT_NAMES = {
    "AMAZONAS": "AMAZONAS", "ANTIOQUIA": "ANTIOQUIA", "ARAUCA": "ARAUCA", "ATLANTICO": "ATLÁNTICO",
    "BOLIVAR": "BOLÍVAR", "BOYACA": "BOYACÁ", "CALDAS": "CALDAS", "CAQUETA": "CAQUETÁ",
    "CASANARE": "CASANARE", "CAUCA": "CAUCA", "CESAR": "CESAR", "CHOCO": "CHOCÓ", "CORDOBA": "CÓRDOBA",
    "CUNDINAMARCA": "CUNDINAMARCA", "GUAINIA": "GUAINÍA", "GUAVIARE": "GUAVIARE", "HUILA": "HUILA",
    "LA GUAJIRA": "LA GUAJIRA", "MAGDALENA": "MAGDALENA", "META": "META", "NARINO": "NARIÑO",
    "NORTE DE SANTANDER": "NORTE DE SANTANDER", "PUTUMAYO": "PUTUMAYO", "QUINDIO": "QUINDÍO",
    "RISARALDA": "RISARALDA", "SAN ANDRES": "SAN ANDRÉS", "SANTANDER": "SANTANDER", "SUCRE": "SUCRE",
    "TOLIMA": "TOLIMA", "VALLE DEL CAUCA": "VALLE DEL CAUCA", "VALLE": "VALLE DEL CAUCA",
    "VAUPES": "VAUPÉS", "VICHADA": "VICHADA", "BOGOTA": "BOGOTÁ D.C.", "BOGOTA DC": "BOGOTÁ D.C.",
    "BOGOTA D C": "BOGOTÁ D.C.", "ARCHIPIELAGO DE SAN ANDRES": "SAN ANDRÉS",
}

# Departments as the gazetteer writes them.
DEPARTMENT_TO_GAZETTEER = {
    "GUAJIRA": "LA GUAJIRA", "VALLE": "VALLE DEL CAUCA", "BOGOTA": "CUNDINAMARCA",
    "SAN ANDRES": "ARCHIPIELAGO DE SAN ANDRES, PROVIDENCIA Y SANTA CATALINA",
}

# Fixed values: (department, place) pairs and the pair the gazetteer has for them.
PLACE_PAIRS = (
    ("ANTIOQUIA", "DON MATIAS", "ANTIOQUIA", "DONMATIAS"),
    ("ANTIOQUIA", "SAN PEDRO", "ANTIOQUIA", "SAN PEDRO DE LOS MILAGROS"),
    ("ANTIOQUIA", "SAN VICENTE", "ANTIOQUIA", "SAN VICENTE FERRER"),
    ("ANTIOQUIA", "SANTAFE DE ANTIOQUIA", "ANTIOQUIA", "SANTA FE DE ANTIOQUIA"),
    ("BOLIVAR", "CARTAGENA", "BOLIVAR", "CARTAGENA DE INDIAS"),
    ("BOLIVAR", "CARTAGO", "VALLE DEL CAUCA", "CARTAGO"),
    ("BOLIVAR", "MOMPOS", "BOLIVAR", "SANTA CRUZ DE MOMPOX"),
    ("BOYACA", "GUICAN", "BOYACA", "GUICAN DE LA SIERRA"),
    ("CAUCA", "LOPEZ", "CAUCA", "LOPEZ DE MICAY"),
    ("CAUCA", "PIENDAMO", "CAUCA", "PIENDAMO - TUNIA"),
    ("CAUCA", "SOTARA", "CAUCA", "SOTARA - PAISPAMBA"),
    ("CAUCA", "SOTARA PAISPAMBA", "CAUCA", "SOTARA - PAISPAMBA"),
    ("CAUCA", "SOTAQUIRA", "BOYACA", "SOTAQUIRA"),
    ("CESAR", "MANAURE", "CESAR", "MANAURE BALCON DEL CESAR"),
    ("CORDOBA", "PURISIMA", "CORDOBA", "PURISIMA DE LA CONCEPCION"),
    ("CORDOBA", "SAN ANDRES SOTAVENTO", "CORDOBA", "SAN ANDRES DE SOTAVENTO"),
    ("CUNDINAMARCA", "SAN JUAN DE RIO SECO", "CUNDINAMARCA", "SAN JUAN DE RIOSECO"),
    ("MAGDALENA", "CERRO SAN ANTONIO", "MAGDALENA", "CERRO DE SAN ANTONIO"),
    ("MAGDALENA", "CHIBOLO", "MAGDALENA", "CHIVOLO"),
    ("NARINO", "CUASPUD", "NARINO", "CUASPUD CARLOSAMA"),
    ("NARINO", "CUASPUD - CARLOSAMA", "NARINO", "CUASPUD CARLOSAMA"),
    ("NORTE DE SANTANDER", "CUCUTA", "NORTE DE SANTANDER", "SAN JOSE DE CUCUTA"),
    ("SUCRE", "TOLU VIEJO", "SUCRE", "SAN JOSE DE TOLUVIEJO"),
    ("TOLIMA", "ARAUQUITA", "ARAUCA", "ARAUQUITA"),
    ("TOLIMA", "MARIQUITA", "TOLIMA", "SAN SEBASTIAN DE MARIQUITA"),
    ("VALLE DEL CAUCA", "CALI", "VALLE DEL CAUCA", "SANTIAGO DE CALI"),
)

# The capital and the department it is counted in.
CAPITAL = "BOGOTA, D.C."
CAPITAL_DEPARTMENT = "CUNDINAMARCA"

# Words found in the place column that name no place, and places outside the gazetteer.
NOT_A_PLACE = ("ACIDO", "AGUA CALIENTE", "VEHICULO", "NAN", "NO REPORTADO", "SIN EMPLEO DE ARMAS")
UNKNOWN_PLACE = "DESCONOCIDO"
UNOFFICIAL_PLACES = ("LA VICTORIA", "PUERTO SANTANDER", "PUERTO COLOMBIA")
UNRECORDED = ("NO REGISTRA",)
UNREPORTED = ("NO REPORTADO",)
BLANK_PLACES = ("-", "", "NO REGISTRA")

# Spellings of a missing category.
CATEGORY_SPELLINGS = {
    "-": "NO REPORTADO", "NO REPORTA": "NO REPORTADO", "NO RESPORTADO": "NO REPORTADO",
    "ADOLSECENTES": "ADOLESCENTES",
}

# Area label whose rows hold the whole population.
WHOLE_AREA = "TOTAL"
