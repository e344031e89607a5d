"""Fixed values of the domain: concept patterns, known entities and noise words, in the order in which they are tried.

All patterns are matched against canonical text (no accents, upper case).
"""

from __future__ import annotations

OWN_BANK = "(el propio banco)"
UNKNOWN_PARTY = "(sin identificar)"

# Concepts of money going out; the first pattern found wins.
OUT_CONCEPTS = (
    ("IVA", r"\bI\.?\s?V\.?\s?A\b|IMPUESTO\s+AL\s+VALOR"),
    ("GMF (4x1000)", r"\bGMF\b|4\s?X\s?1000|GRAVAMEN\s+(?:AL\s+)?MOVIMIENTO|IMPUESTO\s+FINANCIERO|IMPTO\s+GOBIERNO"),
    ("Retención en la fuente", r"RETENCION|RETEFUENTE|RTE\s?FTE"),
    ("Comisiones y cuotas de manejo", r"COMISION|CUOTA\s+(?:DE\s+)?MANEJO|PORTES|TALONARIO|CHEQUERA|CUOTA\s+ADMIN|ADMINISTRACION\s+CUENTA|CONSULTA\s+SALDO"),
    ("Nómina", r"NOMINA|PAGO\s+DE\s+EMPLEADOS|LIQUIDACION\s+LABORAL|SEGURIDAD\s+SOCIAL|APORTES\s+PARAFISCALES|PILA\b"),
    ("Proveedores", r"PROVEEDOR|PAGO\s+DE\s+PROV|PAGO\s+A\s+PROV|MATERIAS?\s+PRIMAS?"),
    ("Servicios públicos y telecomunicaciones", r"SERVICIOS?\s+PUBLICOS?|\bEPM\b|CODENSA|ENEL|EMCALI|AFINIA|AIR-?E|ACUEDUCTO|ALCANTARILLADO|\bGAS\b|VANTI|ENERGIA|CLARO|MOVISTAR|\bTIGO\b|\bETB\b|WOM\b|INTERNET"),
    ("Impuestos y entidades del Estado", r"IMPUESTO|IMPTO|\bDIAN\b|PREDIAL|\bICA\b|INDUSTRIA\s+Y\s+COMERCIO|VEHICULO|DISTRITAL|MUNICIPAL|TESORERIA|SECRETARIA\s+DE\s+HACIENDA"),
    ("Seguros", r"SEGURO|POLIZA|ASEGURADORA|SURA\b|BOLIVAR\b"),
    ("Créditos y obligaciones financieras", r"ABONO\s+(?:A\s+)?CREDITO|CUOTA\s+CREDITO|PAGO\s+CREDITO|LIBRANZA|LEASING|SOBREGIRO|INTERES\s+MORA|TARJETA\s+DE\s+CREDITO"),
    ("Cargos y ajustes del banco", r"CARGO\s+(?:APLICADO|OMISION|POR|DE)|AJUSTE|NOTA\s+DEBITO|OMISION\s+CONSIGNACION"),
    ("Cheques pagados", r"\bCHEQUE\b"),
    ("Retiros y efectivo", r"RETIRO|CAJERO|AVANCE|SACASTE|CORRESPONSAL|EFECTIVO"),
    ("Compras y pagos con tarjeta", r"COMPRA|PAGASTE|PAGO\s+PSE|\bPSE\b|DATAFONO|POS\b"),
    ("Transferencias enviadas", r"TRANSFERENCIA|TRANSF|\bACH\b|ENVIO|ENVIASTE|\bPARA\b|TRASLADO|DISPERSION|ABONO\s+A\s+CUENTA"),
    ("Otros pagos", r"\bPAGO\b|\bPAGOS\b|CARGO|NOTA\s+DEBITO|DEBITO"),
)

# Concepts of money coming in.
IN_CONCEPTS = (
    ("Intereses y rendimientos", r"INTERES|INTERESES\s+GANADOS|RENDIMIENTO|ABONO\s+INTERESES"),
    ("Devoluciones y reversiones", r"DEVOLUCION|REVERSION|REVERSO|ANULACION|REINTEGRO"),
    ("Notas crédito del banco", r"NOTA\s+CREDITO"),
    ("Recargas", r"RECARGA|METES\s+PLATA|METISTE"),
    ("Consignaciones y recaudos", r"CONSIGNACION|CONSIG|RECAUDO|DEPOSITO|EFECTIVO|CHEQUE\s+LOCAL|CHEQUE\s+NACIONAL"),
    ("Transferencias recibidas", r"TRANSFERENCIA|TRANSF|\bACH\b|RECIBISTE|TE\s+ENVIARON|\bDE\b|ABONO|TRASLADO|DISPERSION"),
    ("Ventas y otros ingresos", r"VENTA|DESEMBOLSO|SUBSIDIO|PRESTAMO"),
    ("Pagos recibidos", r"\bPAGO\b|\bPAGOS\b|PROVEEDOR"),
)

OTHER_OUT, OTHER_IN = "Otros egresos", "Otros ingresos"

# Concepts whose other side is the bank itself.
BANK_CONCEPTS = (
    "IVA", "GMF (4x1000)", "Retención en la fuente", "Comisiones y cuotas de manejo", "Intereses y rendimientos",
    "Notas crédito del banco", "Cargos y ajustes del banco",
)

# Entities known by their whole name; the longest found wins.
KNOWN_ENTITIES = (
    "BANCOLOMBIA", "BANCO DE BOGOTA", "BANCO DE OCCIDENTE", "BANCO POPULAR", "BANCO AGRARIO", "BANCO CAJA SOCIAL",
    "BANCO FALABELLA", "BANCO PICHINCHA", "BANCO SERFINANZA", "BANCO UNION", "BANCO W", "BANCO GNB SUDAMERIS",
    "GNB SUDAMERIS", "AV VILLAS", "DAVIVIENDA", "DAVIPLATA", "BBVA", "SCOTIABANK COLPATRIA", "COLPATRIA", "ITAU",
    "BANCOOMEVA", "COOMEVA", "BANCAMIA", "FINANDINA", "MIBANCO", "CONFIAR", "JURISCOOP", "COOPCENTRAL", "LULO BANK",
    "LULO", "NEQUI", "MOVII", "RAPPIPAY", "IRIS", "UALA", "NU COLOMBIA", "BOLD", "SISTECREDITO", "ADDI", "EFECTY",
    "SUPERGIROS", "BALOTO", "GANA", "SU RED", "REDESERVI", "MOVILRED",
)

# Words that say what was done, not with whom.
OPERATION_WORDS = (
    "CRE", "DEB", "NOTA DEBITO", "NOTA CREDITO", "TRANSF", "TRANSFERENCIA", "INTERNET", "VIRTUAL", "SUCURSAL", "CANAL",
    "CORRESPONSAL", "NACIONAL", "LOCAL", "ACH", "PSE", "OI", "PAGO", "PAGOS", "PAGO DE", "ABONO", "CARGO",
    "CONSIGNACION", "CONSIG", "REFEREN", "REFERENCIA", "EFECTIVO", "CHEQUE", "RECAUDO", "DEPOSITO", "RETIRO", "ENVIO",
    "ENVIASTE", "RECIBISTE", "PAGASTE", "SACASTE", "PARA", "PROV", "PROVEEDOR", "PROVEEDORES", "NOMINA", "SERVICIOS",
    "PUBLICOS", "IMPUESTO", "IMPUESTOS", "COMISION", "CUOTA", "MANEJO", "GRAVAMEN", "MOVIMIENTO", "FINANCIERO",
    "OMISION", "APLICADO", "POR", "CUENTA", "ADMINISTRACION", "GANADOS", "MOVIMIENTOS", "PAGADO", "DISTRITALES", "CTA",
    "SUC", "PRIMERA", "SEGUNDA", "QUINCENA", "MES", "AUTOMATICO", "DIARIO", "TRANSACCION", "DESCRIPCION",
)

# Beginnings of words that columns cut short.
CUT_WORDS = ("CORRESPONSA", "REFEREN", "NACIONA", "VIRTUA", "TRANSFEREN", "CONSIGNACIO", "ADMINISTRA", "EMPRES")

# Cities and offices that stick to descriptions.
PLACE_WORDS = (
    "BOGOTA", "MEDELLIN", "CALI", "BARRANQUILLA", "CARTAGENA", "BUCARAMANGA", "PEREIRA", "MANIZALES", "ARMENIA",
    "IBAGUE", "NEIVA", "VILLAVICENCIO", "CUCUTA", "SANTA MARTA", "MONTERIA", "POPAYAN", "PASTO", "TUNJA", "SINCELEJO",
    "VALLEDUPAR", "RIOHACHA", "QUIBDO", "FLORENCIA", "YOPAL", "CHIA", "ENVIGADO", "ITAGUI", "BELLO", "SOACHA",
    "PRINCIPAL", "OFICINA", "GCIA", "BCA", "PYME", "BANCA", "EMPRESARIAL", "PERSONAS", "GERENCIA",
)

# Words that a name doesn't begin or end with.
CONNECTORS = ("DE", "DEL", "A", "AL", "EN", "PARA", "POR", "CON", "LA", "EL", "LOS", "LAS", "UN", "UNA", "Y", "SR", "SRA", "SENOR")
