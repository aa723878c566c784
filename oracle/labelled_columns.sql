SELECT programada_id AS "ID", orden, fecha AS "Fecha", rbd AS "RBD", nombre AS "Colegio", organizador_id AS "Código",
       organizador AS "Organizador", direccion AS "Dirección", comuna_id AS "Comuna", hora_ini AS "Inicio",
       hora_fin AS "Término", hora_ins AS "Instalación", contacto AS "Contacto", contacto_tel AS "Teléfono contacto",
       contacto_mail AS "Correo contacto", contacto_cargo AS "Cargo contacto", orientador AS "Orientador",
       orientador_tel AS "Teléfono orientador", orientador_mail AS "Correo orientador",
       asistentes AS "Asistentes estimados", asistentes_prog AS "Programación de asistencia", estatus AS "Estatus",
       observaciones AS "Observaciones", fecha_lim AS "fecha límite"
FROM visits
