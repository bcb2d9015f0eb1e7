"""The category registry: what each of the 30 categories stores, where it stands in the raw document,
and how it is converted. Everything that depends on a category reads this one table."""

from __future__ import annotations

from dataclasses import dataclass

# fixed values: categories (name, upstream name, label, table), their spec fields, and their facets
# after "@". A field has a conversion and source paths (its own name if none), or several with "or"
# between them, of which the first with a value counts.
TABLE = """
cpu, CPU, CPU, cpu
  manufacturer brand metadata.manufacturer
  family family series metadata.series metadata.name
  generation generation series metadata.series metadata.name
  socket socket
  microarchitecture text
  core_family text coreFamily
  base_clock_ghz positive clocks.performance.base
  boost_clock_ghz positive clocks.performance.boost
  tdp_w positive specifications.tdp
  ppt_w positive specifications.ppt
  max_memory_gb positive specifications.memory.maxSupport
  core_count count cores.total
  thread_count count cores.threads
  performance_cores integer cores.performance
  efficiency_cores integer cores.efficiency
  includes_cooler flag specifications.includesCooler
  @memory_type text specifications.memory.types
memory, RAM, MEM, memory
  ram_type text
  form_factor text
  ecc text
  registered text
  capacity_gb positive capacity or product modules.capacity_gb modules.quantity
  module_capacity_gb positive modules.capacity_gb
  speed positive
  cas_latency positive
  height_mm positive height
  voltage positive
  kit_quantity count modules.quantity
  xmp holds:XMP profile_support
  expo holds:EXPO profile_support
motherboard, Motherboard, M/B, motherboard
  socket socket
  chipset text
  form_factor text
  ram_type text memory.ram_type
  max_memory_gb positive memory.max
  memory_slots integer memory.slots
  m2_slots size
  sata_ports sum storage_devices.sata_6_gb_s storage_devices.sata_3_gb_s
  back_connect flag back_connect_connectors
gpu, GPU, GPU, gpu
  chip_vendor brand chipset_manufacturer
  chipset text
  chip_series series chipset
  memory_type text
  interface text
  vram_gb positive memory
  length_mm positive length
  tdp_w positive tdp
  boost_clock_mhz positive core_boost_clock
  slot_width positive total_slot_width
  pcie_generation pcie_generation interface
  pcie_lanes pcie_lanes interface
  pcie_6_pin integer power_connectors.pcie_6_pin
  pcie_8_pin integer power_connectors.pcie_8_pin
  pcie_12vhpwr integer power_connectors.pcie_12VHPWR
  pcie_12v_2x6 integer power_connectors.pcie_12V_2x6
storage, Storage, Storage, storage
  storage_type text or one_of:SSD|HDD|SSHD type
  form_factor text
  interface text
  capacity_gb positive capacity
  pcie_generation pcie_generation interface
  pcie_lanes pcie_lanes interface
  cache_mb number cache
  nvme flag
psu, PSU, PSU, psu
  form_factor text
  efficiency_rating text
  modular text
  wattage positive
  length_mm positive length
  atx_24_pin integer connectors.atx_24_pin
  eps_8_pin integer connectors.eps_8_pin
  pcie_12vhpwr integer connectors.pcie_12vhpwr
  pcie_6_plus_2_pin integer connectors.pcie_6_plus_2_pin
case, PCCase, Case, pc_case
  form_factor text
  max_gpu_length_mm positive max_video_card_length
  max_cpu_cooler_height_mm positive max_cpu_cooler_height
  max_psu_length_mm positive max_psu_length
  depth_mm positive dimensions_mm.depth
  width_mm positive dimensions_mm.width
  height_mm positive dimensions_mm.height
  volume_l positive volume
  expansion_slots integer
  supports_back_connect flag supports_rear_connecting_motherboard
  @motherboard_form_factor text supported_motherboard_form_factors
  @psu_form_factor text supported_power_supply_form_factors
case_fan, CaseFan, Case Fan, case_fan
  connector text
  flow_direction text
  size_mm positive size
  airflow_min_cfm number min_airflow
  airflow_max_cfm number max_airflow or number min_airflow
  noise_min_db number min_noise_level
  noise_max_db number max_noise_level or number min_noise_level
  static_pressure_mmh2o number static_pressure
  quantity count
  pwm flag
cpu_cooler, CPUCooler, CPU Cooler, cpu_cooler
  height_mm positive height
  radiator_size_mm positive radiator_size
  noise_min_db number min_noise_level
  noise_max_db number max_noise_level or number min_noise_level
  fan_size_mm positive fan_size
  rpm_min number min_fan_rpm
  rpm_max number max_fan_rpm or number min_fan_rpm
  water_cooled flag
  fan_quantity integer
  @socket socket cpu_sockets
accessory, Accessory, Accessory, accessory
capture_card, CaptureCard, Capture Card, capture_card
chair, Chair, Chair, chair
desk, Desk, Desk, desk
headphones, Headphones, Headphones, headphones
  headphone_type text
  ear_cup_type text
  driver_size_mm positive driver_size
  weight_g positive weight
  battery_life_hours number battery_life
  has_microphone flag
  @connection_types text
  @features text
  @platforms text
keyboard, Keyboard, Keyboard, keyboard
  switch_model text switch
  switch_type text
  size text
  layout text
  hot_swappable flag
  polling_rate_hz positive polling_rate
  battery_capacity_mah number battery_capacity
  @connectivity text
  @features text
laptop, Laptop, Laptop, laptop
lighting, Lighting, Lighting, lighting
microphone, Microphone, Microphone, microphone
  @connectivity_type text
  @polar_pattern text
  @features text
monitor, Monitor, Monitor, monitor
  screen_size_inches positive screen_size
  resolution_width integer resolution.horizontalRes
  resolution_height integer resolution.verticalRes
  refresh_rate_hz positive refresh_rate
  panel_type text
  response_time_ms number response_time
  hdr text
  brightness_nits positive max_brightness
  adaptive_sync text
  aspect_ratio text
  @ports present video_outputs
mouse, Mouse, Mouse, mouse
  shape text
  size text
  sensor text
  weight_g positive weight
  max_dpi positive
  polling_rate_hz positive polling_rate
  buttons integer
  battery_life_hours number battery_life
  length_mm positive dimensions.length
  width_mm positive dimensions.width
  height_mm positive dimensions.height
  @connectivity text
  @grip_types text
mousepad, Mousepad, Mousepad, mousepad
network_card, NetworkCard, Network Card, network_card
os, OS, Operating System, os
prebuilt_desktop, PrebuiltDesktop, Prebuilt Desktop, prebuilt_desktop
sound_card, SoundCard, Sound Card, sound_card
speaker, Speaker, Speaker, speaker
stand, Stand, Stand, stand
thermal_compound, ThermalCompound, Thermal Compound, thermal_compound
vr_headset, VRHeadset, VR Headset, vr_headset
webcam, Webcam, Webcam, webcam
  resolution text
  frame_rate_fps rate frame_rate
  @connectivity_type text
"""

# fixed values: monitor ports that are facets, and frame rates as they are written
PORTS = ("hdmi_2_2", "hdmi_2_1", "hdmi_2_1a", "hdmi_2_1b", "hdmi_2_0", "hdmi_2_0a", "hdmi_2_0b", "displayport_2_1", "displayport_2_1a", "displayport_1_4a", "displayport_2_1_b", "usb_c", "dvi_d", "vga")
RATES = {"24fps": 24, "30fps": 30, "60fps": 60, "90fps": 90, "120fps": 120}
# fixed values: fields of all categories, by type
COMMON = {"metadata.manufacturer": "text", "metadata.series": "text", "metadata.variant": "text", "general_product_information.manufacturer_url": "text", "metadata.releaseYear": "integer", "metadata.part_numbers": "array"}

#: What the contract asks of a conversion's source.
INPUT = {"number": "number", "positive": "number", "integer": "integer", "count": "integer", "sum": "integer", "flag": "boolean", "size": "objects", "holds": "array"}
#: The type that a conversion gives (text where none is named).
OUTPUT = {"number": "double", "positive": "double", "product": "double", "pcie_generation": "double", "integer": "bigint", "count": "bigint", "sum": "bigint", "size": "bigint", "pcie_lanes": "bigint", "holds": "bigint", "flag": "bigint", "rate": "bigint"}


@dataclass(frozen=True)
class Source:
    conversion: str
    paths: tuple[str, ...]
    values: tuple[str, ...] = ()


@dataclass(frozen=True)
class Field:
    name: str
    sources: tuple[Source, ...]

    @property
    def type(self) -> str:
        return OUTPUT.get(self.sources[0].conversion, "string")


@dataclass(frozen=True)
class Category:
    name: str
    upstream: str
    label: str
    table: str
    fields: tuple[Field, ...]
    facets: tuple[Field, ...]

    def inputs(self) -> dict[str, str]:
        """The type that the contract asks at each source path, those of all categories first."""
        out = dict(COMMON)
        for f in self.fields:
            for s in f.sources:
                for path in s.paths if s.conversion != "product" else ():  # a product's factors are fields too
                    out.setdefault(path, INPUT.get(s.conversion, "text"))
        for f in self.facets:
            out |= {f"{f.sources[0].paths[0]}.{p}": "integer" for p in PORTS} if f.sources[0].conversion == "present" else {f.sources[0].paths[0]: "array"}
        return {p: t for p, t in out.items() if p != "metadata.name"}


def _field(line: str) -> Field:
    name, _, rest = line.partition(" ")
    sources = []
    for part in rest.split(" or "):
        conversion, *paths = part.split()
        conversion, _, values = conversion.partition(":")
        sources.append(Source(conversion, tuple(paths) or (name.lstrip("@"),), tuple(v for v in values.split("|") if v)))
    return Field(name.lstrip("@"), tuple(sources))


def _read(table: str) -> dict[str, Category]:
    out: dict[str, Category] = {}
    for line in table.strip().splitlines():
        if not line.startswith(" "):
            name, *rest = line.split(", ")
            out[name] = Category(name, *rest, fields=(), facets=())
            continue
        c, f = out[name], _field(line.strip())
        facet = line.strip().startswith("@")
        out[name] = Category(c.name, c.upstream, c.label, c.table, c.fields if facet else (*c.fields, f), (*c.facets, f) if facet else c.facets)
    return out


CATEGORIES = _read(TABLE)
#: The categories whose fields came before those declared by path alone.
ORIGINAL = ("cpu", "memory", "motherboard", "gpu", "storage", "psu", "case", "case_fan", "cpu_cooler")


def tree(category: str) -> dict[str, bool]:
    """Every modeled path and path prefix of a category, and whether paths go on below it."""
    out: dict[str, bool] = {}
    for path in ("opendb_id", "metadata.name", "identifiers", *CATEGORIES[category].inputs()):
        keys = path.split(".")
        for n in range(1, len(keys) + 1):
            p = ".".join(keys[:n])
            out[p] = out.get(p, False) or n < len(keys)
    return out
