import pytest

from mossgrid.sources import small_files
from mossgrid.sources.model_parameters import _FILE_PATHS, _VALUE_PATHS, ModelDocument, read_document
from mossgrid.sources.small_files import Variable

DOCUMENT = """<model><parameter_set>FULL</parameter_set>
<file_locations><model_directory>/models/a</model_directory><plot_id_field>FCID</plot_id_field><species_matrix_file>spp.csv</species_matrix_file>
 <stand_attribute_file>stand.csv</stand_attribute_file><footprint_file>/shared/single.txt</footprint_file><boundary_raster>b.tif</boundary_raster></file_locations>
<model_parameters><model_region>224</model_region><model_year>2006</model_year>
 <model_type><sppsz><image_source>TM</image_source><image_version>2.5</image_version>
  <plot_image_crosswalk><plot_image_pair><plot_year>2001</plot_year><image_year>2000</image_year></plot_image_pair><plot_image_pair><plot_year>2005</plot_year><image_year>2006</image_year></plot_image_pair></plot_image_crosswalk></sppsz></model_type>
 <buffer>1</buffer><plot_types><INVENTORY>1</INVENTORY><ECOLOGY>0</ECOLOGY></plot_types><exclusion_codes><COORDS>0</COORDS><DISTURB>1</DISTURB></exclusion_codes></model_parameters>
<ordination_parameters><vegan><distance_metric>CCA</distance_metric><species_transform>SQRT</species_transform><species_downweighting>1</species_downweighting><vegan_file>vegan.txt</vegan_file></vegan>
 <variable_filter>RAW</variable_filter><ordination_variables>
 <ordination_variable variable_type="STATIC"><variable_name>DEM</variable_name><variable_path>/r/dem</variable_path></ordination_variable>
 <ordination_variable variable_type="TEMPORAL" model_year="2000"><variable_name>TC1</variable_name><variable_path>/r/tc1</variable_path></ordination_variable>
 <ordination_variable variable_type="TEMPORAL" model_year="2006"><variable_name>TC1</variable_name><variable_path>/r/tc1</variable_path></ordination_variable>
 <ordination_variable variable_type="TEMPORAL" model_year="2000"><variable_name>OLD</variable_name><variable_path>/r/old</variable_path></ordination_variable></ordination_variables></ordination_parameters>
<imputation_parameters><number_axes>6</number_axes><use_axis_weighting>0</use_axis_weighting><k>3</k><weights><weight>2</weight><weight>1</weight><weight>1</weight></weights><max_neighbors>50</max_neighbors></imputation_parameters>
<domain_parameters><window><envelope><x_min>1</x_min><y_min>2</y_min><x_max>30.5</x_max><y_max>40</y_max></envelope><cell_size>30</cell_size><output><neighbor_file>nn</neighbor_file></output></window><write_axes>1</write_axes></domain_parameters>
<accuracy_assessment><accuracy_assessment_folder>aa</accuracy_assessment_folder><accuracy_assessment_report>report.pdf</accuracy_assessment_report><diagnostics>
 <local_accuracy><include_in_report>1</include_in_report><output_file>local.csv</output_file></local_accuracy>
 <error_matrix_accuracy><include_in_report>0</include_in_report><error_matrix_file>em.csv</error_matrix_file><classification_bin_file>bins.csv</classification_bin_file><bin_method>QUANTILE</bin_method><bin_count>7</bin_count></error_matrix_accuracy>
 <regional_accuracy><assessment_year>2006</assessment_year><output_folder>regional</output_folder><area_estimate_file>area.csv</area_estimate_file><output_file>regional.csv</output_file></regional_accuracy>
 <riemann_accuracy><output_folder>riemann</output_folder><hex_id_file>hex.csv</hex_id_file><hex_resolutions><hex_resolution><field_name>HEX_10</field_name><intercell_spacing>10</intercell_spacing><area>8660.3</area><minimum_plots_per_hex>3</minimum_plots_per_hex></hex_resolution></hex_resolutions>
  <k_values><k_value><k>1</k><weights><keyword>EQUAL</keyword></weights></k_value><k_value><k>2</k><weights><weight>3</weight><weight>1</weight></weights></k_value></k_values></riemann_accuracy></diagnostics></accuracy_assessment>
<outlier_assessment><outlier_assessment_folder>out</outlier_assessment_folder><diagnostics><nn_index_outlier><nn_index_outlier_file>nn.csv</nn_index_outlier_file><index_threshold>12.5</index_threshold></nn_index_outlier>
 <variable_deviation_outlier><output_file>dev.csv</output_file><variable><variable_name>BAA</variable_name><min_deviation>20</min_deviation></variable></variable_deviation_outlier></diagnostics></outlier_assessment></model>"""


@pytest.fixture
def path(tmp_path):
    out = tmp_path / "model.xml"
    out.write_text(DOCUMENT)
    return str(out)


def test_values_and_files(path):
    d = read_document(path)
    assert (d["parameter_set"], d["model_region"], d["buffer"], d["lump_table"], d["error_matrix_bin_method"], d["index_threshold"]) == ("FULL", 224, 1, None, "QUANTILE", 12.5)
    assert d.file("species_matrix_file") == "/models/a/spp.csv" and d.file("footprint_file") == "/shared/single.txt" and d.file("boundary_raster") == "b.tif"
    assert d.file("local_accuracy_file") == "/models/a/aa/local.csv" and d.file("accuracy_assessment_report") == "/models/a/aa/report.pdf"
    assert d.file("regional_accuracy_file") == "/models/a/aa/regional/regional.csv" and d.file("hex_id_file") == "/models/a/aa/riemann/hex.csv"
    assert d.file("nn_index_outlier_file") == "/models/a/out/nn.csv" and d["variable_deviation_file"] == "/models/a/out/dev.csv"
    assert d.file("id_list_file") is None and d.neighbor_file(2) == "/models/a/nn2.tif"
    assert len(set(_FILE_PATHS) & set(_VALUE_PATHS)) == 0 and all(d[n] is None or d[n] != "" for n in d.names())
    with pytest.raises(KeyError):
        d["no_such_value"]


def test_lists(path):
    d = read_document(path)
    assert d.model_type == "sppsz" and d.image == ("TM", 2.5) and d.image_years == [(2001, 2000), (2005, 2006)] and d.plot_years == [2001, 2005]
    assert d.plot_types == ["inventory"] and d.exclusion_codes == ["coords"]
    assert d.ordination == {"program": "vegan", "metric": "CCA", "transform": "SQRT", "downweighting": 1, "file": "/models/a/vegan.txt"}
    assert d.variables == [Variable("DEM", "/r/dem"), Variable("TC1", "/r/tc1", (2000, 2006)), Variable("OLD", "/r/old", (2000,))]
    assert d.weights == (0.5, 0.25, 0.25) and d.k_values == [(1, "EQUAL"), (2, (0.75, 0.25))]
    assert d.domain == "window" and d.envelope == [1, 2, 30.5, 40] and d.window["cell_size"] == 30
    assert d.accuracy_diagnostics == ["local_accuracy", "error_matrix_accuracy", "regional_accuracy", "riemann_accuracy"] and d.in_report == ["local_accuracy"]
    assert d.hex_levels[0].column == "HEX_10" and d.hex_levels[0].min_plots == 3 and d.deviations == [("BAA", 20.0)]


def test_parameters(path):
    p = small_files.read_parameters(path)
    assert p.ordination.names(2006) == ["DEM", "TC1"] and p.ordination.names(1999) == ["DEM"]
    assert (p.imputation.axes, p.imputation.axis_weighting, p.imputation.k, p.imputation.max_neighbors) == (6, False, 3, 50) and p.imputation.weight_list() == [0.5, 0.25, 0.25]
    assert p.accuracy.bins == 7 and p.accuracy.k_values == (1, 2) and dict(p.accuracy.k_weights)[2] == (0.75, 0.25)
    assert p.path("local_accuracy_file") == "/models/a/aa/local.csv" and p.path("ordination_file") == "/models/a/vegan.txt"
    assert p.outliers.deviations == (("BAA", 20.0),) and p.outliers.index_threshold == 12.5


def test_domains(spark, tmp_path):
    of = lambda inner: ModelDocument(__import__("xml.etree.ElementTree", fromlist=["x"]).fromstring(f"<m><domain_parameters>{inner}</domain_parameters></m>"))
    assert [tuple(r) for r in of("<point><x>1.5</x><y>2</y></point>").points(spark).collect()] == [(1.5, 2.0)]
    assert of("<list><points><point><x>1</x><y>2</y></point><point><x>3</x><y>4</y></point></points></list>").points(spark).count() == 2
    (tmp_path / "p.csv").write_text("X,Y\n5,6\n")
    assert [tuple(r) for r in of(f"<list><file>{tmp_path}/p.csv</file></list>").points(spark).collect()] == [(5.0, 6.0)]
    assert of("<window/>").points(spark) is None and of("").domain is None


def test_changes_and_remote_folders(path, tmp_path):
    d = read_document(path)
    d.set("model_year", 2010), d.set("id_list_file", "ids.csv"), d.set_envelope([0, 1, 2, 3]), d.set("model_region", 7)
    d.set_variables([Variable("A", "/a"), Variable("B", "/b", (2001, 2002))])
    d.root.find("file_locations/model_directory").text = "hdfs://host/models"
    d.write(str(tmp_path / "out.xml"))
    e = read_document(str(tmp_path / "out.xml"))
    assert e["model_year"] == 2010 and e.envelope == [0, 1, 2, 3] and e.variables == d.variables == [Variable("A", "/a"), Variable("B", "/b", (2001, 2002))]
    assert e.file("id_list_file") == "hdfs://host/models/ids.csv" and e.file("hex_id_file") == "hdfs://host/models/aa/riemann/hex.csv"
    assert e.parameters().path("hex_id_file") == "hdfs://host/models/aa/riemann/hex.csv"
    with pytest.raises(ValueError):
        e.set_plot_years([2001])


@pytest.mark.parametrize("old,new", [("<k>3</k>", "<k>three</k>"), ("<k>3</k>", "<k>2</k>"), ("<keyword>EQUAL</keyword>", "<keyword>ODD</keyword>"), ("<vegan>", "<other>"), ("variable_type=\"STATIC\"", "variable_type=\"ODD\"")])
def test_bad_values_tell_their_place(tmp_path, old, new):
    text = DOCUMENT.replace(old, new).replace("</vegan>", "</other>" if new == "<other>" else "</vegan>")
    (tmp_path / "bad.xml").write_text(text)
    with pytest.raises(ValueError):
        small_files.read_parameters(str(tmp_path / "bad.xml"))
