"""Layers for exchange: attribute tables, GeoJSON and KML text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Flow-path and channel parameters: description, unit, geometry kind (fixed values)
CHARACTERISTIC = {
    "MAIN_CHANNEL": ("Panjang sungai utama (Lm)", "km", "GARIS"), "L": ("Lintasan aliran terpanjang dari outlet ke hulu", "km", "GARIS"),
    "LCA": ("Lintasan aliran dari outlet sampai posisi terdekat sentroid", "km", "GARIS"), "L10_85": ("Bagian lintasan aliran antara posisi 10% dan 85% L", "km", "GARIS"),
    "C": ("Sentroid DTA", "", "TITIK"), "L10": ("Ujung 10% lintasan L", "km", "TITIK"), "L85": ("Ujung 85% lintasan L", "km", "TITIK"),
}
# Gama-I parameters: description, unit, geometry kind (fixed values)
GAMA = {
    "AU": ("Luas DTA hulu", "km²", "AREA"), "WL": ("Lebar DTA pada 0,25 L", "km", "GARIS"), "WU": ("Lebar DTA pada 0,75 L", "km", "GARIS"),
    "XA": ("Garis lurus outlet X ke titik A", "km", "GARIS"), "XB": ("Garis lurus outlet X ke titik B", "km", "GARIS"), "XC": ("Garis lurus outlet X ke titik terakhir Lca (C)", "km", "GARIS"),
    "A": ("Titik 0,25 L dari outlet sepanjang lintasan L", "km", "TITIK"), "B": ("Titik 0,75 L dari outlet sepanjang lintasan L", "km", "TITIK"),
    "C": ("Titik terakhir Lca yang digunakan sebagai acuan pembagi AU", "km", "TITIK"),
}


def catchment_layer(df: DataFrame) -> DataFrame:
    """ID, NAMA, LUAS_KM2, DAS, SUNGAI, SUMBER of ``point_id, label, area_km2, basin_name, river_name, source``."""
    return df.select(F.col("point_id").alias("ID"), F.coalesce(F.nullif(F.col("label"), F.lit("")), F.col("point_id")).alias("NAMA"), F.col("area_km2").alias("LUAS_KM2"),
                     F.col("basin_name").alias("DAS"), F.col("river_name").alias("SUNGAI"), F.col("source").alias("SUMBER"))


def outlet_layer(df: DataFrame) -> DataFrame:
    """ID, NAMA, DAS, SUNGAI, LINTANG, BUJUR."""
    return df.select(F.col("point_id").alias("ID"), F.coalesce(F.nullif(F.col("label"), F.lit("")), F.col("point_id")).alias("NAMA"), F.col("basin_name").alias("DAS"),
                     F.col("river_name").alias("SUNGAI"), F.col("lat").cast("double").alias("LINTANG"), F.col("lon").cast("double").alias("BUJUR"))


def _parameter_layer(df: DataFrame, table: dict) -> DataFrame:
    items = F.array(*[F.struct(F.lit(p).alias("PARAM"), F.lit(d).alias("KETERANGAN"), (F.col(p) if p in df.columns else F.lit(None)).cast("double").alias("NILAI"),
                               F.lit(u).alias("SATUAN"), F.lit(k).alias("KIND"), F.lit(p in df.columns).alias("_have")) for p, (d, u, k) in table.items()])
    long = df.select(F.col("point_id").alias("ID"), F.coalesce(F.nullif(F.col("label"), F.lit("")), F.col("point_id")).alias("NAMA"), F.col("source").alias("SUMBER"), F.inline(items))
    return long.filter("_have").select("ID", "NAMA", "PARAM", "KETERANGAN", "NILAI", "SATUAN", "KIND", "SUMBER")


def characteristic_layers(df: DataFrame) -> DataFrame:
    """Flow-path parameters as long rows; ``KIND`` groups lines and points."""
    return _parameter_layer(df, CHARACTERISTIC)


def gama_layers(df: DataFrame) -> DataFrame:
    """Gama-I parameters as long rows; ``KIND`` groups area, lines and points."""
    return _parameter_layer(df, GAMA)


def drop_empty(df: DataFrame, source: str = "SUMBER") -> DataFrame:
    """Leave out columns empty in the whole layer; the source column comes last.

    One aggregate finds the columns; only their names reach the driver.
    """
    def useful(f):
        c = F.col(f"`{f.name}`")
        return F.count_if(c.isNotNull() & (F.trim(c.cast("string")) != "") & (F.lower(c.cast("string")) != "nan"))

    seen = df.agg(*[useful(f).alias(f.name) for f in df.schema.fields]).first()
    keep = [c for c in df.columns if seen[c] > 0]
    if source in keep:
        keep = [c for c in keep if c != source] + [source]
    return df.select(*keep)


def ring_coordinates(edges: DataFrame, digits: int) -> DataFrame:
    """Closed coordinate list of each ring: ``poly_id, part, ring, coords``.

    One array per ring: a ring is one feature of the output and has to be one value.
    """
    pts = edges.groupBy("poly_id", "part", "ring").agg(F.sort_array(F.collect_list(F.struct("seq", F.round("x1", digits).alias("x"), F.round("y1", digits).alias("y")))).alias("_p"))
    xy = F.transform("_p", lambda p: F.array(p["x"], p["y"]))
    return pts.select("poly_id", "part", "ring", F.concat(xy, F.slice(xy, 1, 1)).alias("coords"))


def multipolygons(edges: DataFrame, digits: int) -> DataFrame:
    """``poly_id, coordinates``: parts with their rings, outer ring first."""
    rings = ring_coordinates(edges, digits)
    parts = rings.groupBy("poly_id", "part").agg(F.transform(F.sort_array(F.collect_list(F.struct("ring", "coords"))), lambda r: r["coords"]).alias("rings"))
    return parts.groupBy("poly_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("part", "rings"))), lambda p: p["rings"]).alias("coordinates"))


def to_geojson(edges: DataFrame, attributes: DataFrame, *, digits: int = 7, key: str = "poly_id") -> DataFrame:
    """One GeoJSON feature per polygon as text: ``key, feature``."""
    props = [c for c in attributes.columns if c != key]
    feature = F.struct(F.lit("Feature").alias("type"), F.struct(*props).alias("properties"),
                       F.struct(F.lit("MultiPolygon").alias("type"), F.col("coordinates")).alias("geometry"))
    return multipolygons(edges, digits).withColumnRenamed("poly_id", key).join(attributes, key, "left").select(key, F.to_json(feature).alias("feature"))


def _geometry(kind: str, coordinates: Column) -> Column:
    return F.to_json(F.struct(F.lit(kind).alias("type"), coordinates.alias("coordinates")))


def with_areas(layer: DataFrame, edges: DataFrame, *, digits: int = 7) -> DataFrame:
    """The layer with ``GEOMETRY``, the GeoJSON text of the polygon whose ``poly_id`` is its ``ID`` (NULL without one)."""
    shapes = multipolygons(edges, digits).select(F.col("poly_id").alias("ID"), _geometry("MultiPolygon", F.col("coordinates")).alias("GEOMETRY"))
    return layer.join(shapes, "ID", "left")


def with_parameters(layer: DataFrame, vertices: DataFrame, edges: DataFrame | None = None, *, digits: int = 7) -> DataFrame:
    """A parameter layer with ``GEOMETRY`` by its ``KIND``: lines and points from ``vertices`` (``ID, PARAM, seq, x, y``), areas from
    ``edges`` (``poly_id`` = ``ID``).  A line is one feature and has to be one value; one vertex makes a point."""
    xy = F.sort_array(F.collect_list(F.struct("seq", F.array(F.round("x", digits), F.round("y", digits)).alias("at"))))
    path = vertices.groupBy("ID", "PARAM").agg(F.transform(xy, lambda v: v["at"]).alias("path"))
    out = layer.join(path, ["ID", "PARAM"], "left")
    area = F.lit(None).cast("string")
    if edges is not None:
        shapes = multipolygons(edges, digits).select(F.col("poly_id").alias("ID"), F.col("coordinates").alias("_c"))
        out, area = out.join(shapes, "ID", "left"), F.when(F.col("_c").isNotNull(), _geometry("MultiPolygon", F.col("_c")))
    shape = F.when(F.col("KIND") == "AREA", area).when((F.col("KIND") == "TITIK") & F.col("path").isNotNull(), _geometry("Point", F.element_at("path", 1))).when(
        F.size("path") > 1, _geometry("LineString", F.col("path")))
    return out.withColumn("GEOMETRY", shape).select(*layer.columns, "GEOMETRY")


def xml_escape(c: Column) -> Column:
    return F.replace(F.replace(F.replace(c, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))


def _placemark(fields: list[str], shape: Column) -> Column:
    data = F.concat_ws("", *[F.when(F.col(f).isNotNull() & (F.trim(F.col(f).cast("string")) != ""), F.concat(
        F.lit(f'<Data name="{f}"><value>'), xml_escape(F.col(f).cast("string")), F.lit("</value></Data>"))) for f in fields])
    label = xml_escape(F.coalesce(F.nullif(F.col("NAMA"), F.lit("")), F.col("ID").cast("string")))
    return F.concat(F.lit("<Placemark><name>"), label, F.lit("</name>"), F.when(data != "", F.concat(F.lit("<ExtendedData>"), data, F.lit("</ExtendedData>"))).otherwise(""), shape, F.lit("</Placemark>"))


def _fixed(c: Column) -> Column:
    """Eight decimals of the exact value of a double.

    ``format_string`` pads the shortest decimal that names the double, which is off in the eighth place from about 1e7 on.
    """
    size, whole = F.abs(c), F.floor(F.abs(c))
    units = F.rint((size - whole) * 1e8).cast("long")
    text = F.concat((whole + F.floor(units / 100_000_000)).cast("string"), F.lit("."), F.lpad((units % 100_000_000).cast("string"), 8, "0"))
    return F.when((size >= 1e7) & (size < 9e15), F.concat(F.when(c < 0, "-").otherwise(""), text)).otherwise(F.format_string("%.8f", c))


def _places(path: Column) -> Column:
    return F.concat(F.lit("<coordinates>"), F.concat_ws(" ", F.transform(path, lambda v: F.concat(_fixed(v[0]), F.lit(","), _fixed(v[1]), F.lit(",0")))), F.lit("</coordinates>"))


def to_kml(points: DataFrame, fields: list[str]) -> DataFrame:
    """KML placemark text of point rows ``ID, NAMA, lon, lat`` with the non-empty ``fields`` as data."""
    shape = F.format_string("<Point><coordinates>%.8f,%.8f,0</coordinates></Point>", "lon", "lat")
    return points.select("ID", _placemark(fields, shape).alias("placemark"))


def lines_to_kml(lines: DataFrame, vertices: DataFrame, fields: list[str]) -> DataFrame:
    """KML placemark text of lines: rows ``ID, NAMA`` and their ``vertices`` (``ID, seq, x, y``)."""
    path = vertices.groupBy("ID").agg(F.transform(F.sort_array(F.collect_list(F.struct("seq", F.array("x", "y").alias("at")))), lambda v: v["at"]).alias("path"))
    shape = F.concat(F.lit("<LineString>"), _places(F.col("path")), F.lit("</LineString>"))
    return lines.join(path, "ID").select("ID", _placemark(fields, shape).alias("placemark"))


def areas_to_kml(areas: DataFrame, edges: DataFrame, fields: list[str], *, digits: int = 8) -> DataFrame:
    """KML placemark text of polygons: rows ``ID, NAMA`` and ``edges`` with ``poly_id`` = ``ID``; holes are inner boundaries."""
    def ring(tag: str, path: Column) -> Column:
        return F.concat(F.lit(f"<{tag}><LinearRing>"), _places(path), F.lit(f"</LinearRing></{tag}>"))

    part = lambda rings: F.concat(F.lit("<Polygon>"), ring("outerBoundaryIs", F.element_at(rings, 1)), F.concat_ws("", F.transform(F.slice(rings, 2, F.size(rings)), lambda r: ring("innerBoundaryIs", r))), F.lit("</Polygon>"))
    shape = F.concat(F.lit("<MultiGeometry>"), F.concat_ws("", F.transform("coordinates", part)), F.lit("</MultiGeometry>"))
    return areas.join(multipolygons(edges, digits).withColumnRenamed("poly_id", "ID"), "ID").select("ID", _placemark(fields, shape).alias("placemark"))


KML_HEAD = '<?xml version="1.0" encoding="UTF-8"?><kml xmlns="http://www.opengis.net/kml/2.2"><Document><name>{name}</name>'
KML_TAIL = "</Document></kml>"


EXPORT_BUCKETS = 64


def export(layers: dict[str, DataFrame], root: str, *, formats: list[str]) -> list[str]:
    """Write each layer per format, split by mode and a hash bucket of the point; returns the folders.

    Layers carry ``point_id`` and ``mode`` (smoothed or raw).  A bucket's file is ordered by
    point, so one outlet is read from one file and folders do not grow with the outlets.
    """
    out = []
    for name, df in layers.items():
        for fmt in formats:
            path = f"{root}/{name}/{fmt}"
            split = df.withColumn("bucket", F.pmod(F.xxhash64("point_id"), F.lit(EXPORT_BUCKETS)))
            split.repartition("mode", "bucket").sortWithinPartitions("mode", "bucket", "point_id").write.mode("overwrite").partitionBy("mode", "bucket").format(fmt).save(path)
            out.append(path)
    return out
