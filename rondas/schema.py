"""Table schemas, closed domains, column orders and display labels."""

from __future__ import annotations

from pyspark.sql import types as T

VISIT_SCHEMA = T.StructType(
    [
        T.StructField("programada_id", T.LongType()),
        T.StructField("orden", T.LongType()),
        T.StructField("organizador_id", T.IntegerType()),
        T.StructField("organizador", T.StringType()),
        T.StructField("fecha", T.DateType()),
        T.StructField("rbd", T.LongType()),
        T.StructField("nombre", T.StringType()),
        T.StructField("direccion", T.StringType()),
        T.StructField("comuna_id", T.IntegerType()),
        T.StructField("hora_ini", T.StringType()),
        T.StructField("hora_fin", T.StringType()),
        T.StructField("hora_ins", T.StringType()),
        T.StructField("contacto", T.StringType()),
        T.StructField("contacto_tel", T.StringType()),
        T.StructField("contacto_mail", T.StringType()),
        T.StructField("contacto_cargo", T.StringType()),
        T.StructField("orientador", T.StringType()),
        T.StructField("orientador_tel", T.StringType()),
        T.StructField("orientador_mail", T.StringType()),
        T.StructField("asistentes", T.StringType()),
        T.StructField("asistentes_prog", T.StringType()),
        T.StructField("estatus", T.StringType()),
        T.StructField("observaciones", T.StringType()),
        T.StructField("fecha_lim", T.DateType()),
    ]
)

ATTENDANCE_SCHEMA = T.StructType(
    [
        T.StructField("programada_id", T.LongType()),
        T.StructField("codigo", T.IntegerType()),
        T.StructField("asiste", T.IntegerType()),
        T.StructField("invitacion", T.IntegerType()),
    ]
)

UNIVERSITY_SCHEMA = "codigo int, universidad string"
SCHOOL_SCHEMA = "rbd long, nombre string, cod_com int"
COMMUNE_SCHEMA = "comuna_id int, comuna string"
HOLIDAY_SCHEMA = "fecha date"
SLOT_SCHEMA = "hora string, etiqueta string"

# One change to one field of one visit; `campo` and `valor` are null for a delete.
CHANGE_SCHEMA = "seq long, programada_id long, accion string, campo string, valor string"

TIME_COLUMNS = ("hora_ini", "hora_fin", "hora_ins")
DATE_COLUMNS = ("fecha", "fecha_lim")

# ---------------------------------------------------------------- fixed values
# These must equal the original application's for results to agree.

CONFIRMED = "Confirmada"
UNCONFIRMED = "Por confirmar"
SUSPENDED = "Suspendida"
DONE = "Realizada"
STATUSES = (CONFIRMED, UNCONFIRMED, SUSPENDED, DONE)
ACTIVE_STATUSES = (CONFIRMED, UNCONFIRMED)

ANSWER_NO, ANSWER_YES, ANSWER_OPEN = 0, 1, 2
ANSWER_LABELS = {0: "No", 1: "Sí", 2: "No confirmada"}

PUBLIC_USER = 0
PUBLIC_USER_LABEL = "Usuario no acreditado"

# Organiser's view of a visit.
TYPE_UPCOMING, TYPE_OVERDUE, TYPE_CLOSED, TYPE_SUSPENDED = 0, 1, 2, 3

LABELS = {
    "programada_id": "ID",
    "orden": "orden",
    "fecha": "Fecha",
    "rbd": "RBD",
    "nombre": "Colegio",
    "organizador_id": "Código",
    "organizador": "Organizador",
    "direccion": "Dirección",
    "comuna_id": "Comuna",
    "hora_ini": "Inicio",
    "hora_fin": "Término",
    "hora_ins": "Instalación",
    "contacto": "Contacto",
    "contacto_tel": "Teléfono contacto",
    "contacto_mail": "Correo contacto",
    "contacto_cargo": "Cargo contacto",
    "orientador": "Orientador",
    "orientador_tel": "Teléfono orientador",
    "orientador_mail": "Correo orientador",
    "asistentes": "Asistentes estimados",
    "asistentes_prog": "Programación de asistencia",
    "estatus": "Estatus",
    "observaciones": "Observaciones",
    "fecha_lim": "fecha límite",
}

# Column orders of the visit grid, of one date and of the detailed export.
GRID_COLUMNS = ("programada_id", "orden", "fecha", "rbd", "nombre", "organizador_id", "organizador", "estatus")
DATE_GRID_COLUMNS = ("orden", "rbd", "nombre", "organizador", "estatus")
DETAIL_COLUMNS = (
    "programada_id", "orden", "fecha", "organizador_id", "organizador", "nombre", "rbd", "direccion",
    "comuna_id", "hora_ins", "hora_ini", "hora_fin", "contacto", "contacto_tel", "contacto_mail",
    "contacto_cargo", "orientador", "orientador_tel", "orientador_mail", "asistentes", "asistentes_prog",
    "estatus", "observaciones",
)

# Fields of the edit form, in form order.
FORM_FIELDS = (
    "fecha", "direccion", "comuna_id", "hora_ini", "hora_fin", "hora_ins", "contacto", "contacto_tel",
    "contacto_mail", "contacto_cargo", "orientador", "orientador_tel", "orientador_mail", "asistentes",
    "asistentes_prog", "estatus", "observaciones",
)

# Items of the visit report and their labels, in print order.
REPORT_ITEMS = {
    "estatus": "Estatus",
    "organizador": "Organizador",
    "nombre": "Nombre",
    "rbd": "RBD",
    "fecha": "Fecha",
    "direccion": "Dirección",
    "comuna_id": "Comuna",
    "hora_ins": "Hora instalación",
    "hora_ini": "Hora inicio",
    "hora_fin": "Hora término",
    "orientador": "Orientador/a",
    "asistentes": "Asistentes",
}

# Attendance sections of the report, in print order.
SECTION_TITLES = {
    1: "Universidades que asisten:",
    0: "Universidades que no asisten:",
    2: "Universidades sin confirmación:",
}

WEEKDAYS = ("Lunes", "Martes", "Miércoles", "Jueves", "Viernes", "Sábado", "Domingo")
MONTHS = (
    "Enero", "Febrero", "Marzo", "Abril", "Mayo", "Junio",
    "Julio", "Agosto", "Septiembre", "Octubre", "Noviembre", "Diciembre",
)
SHORT_MONTHS = ("Ene", "Feb", "Mar", "Abr", "May", "Jun", "Jul", "Ago", "Sep", "Oct", "Nov", "Dic")
ALL_MONTHS_LABEL = "Todos"

CALENDAR_NAME_WIDTH = 40
BUSINESS_DAY_WINDOW = 14
# ------------------------------------------------------------ end fixed values
